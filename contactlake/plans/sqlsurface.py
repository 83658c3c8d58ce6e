"""Queries written in SQL over the registered functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactlake.functions import surface
from contactlake.functions.values import EMAIL_CATEGORIES
from contactlake.operators.pages import register_page_facts

from .pagequeries import CARD, PERSON, made
from .registry import query


@query("sql_scalar_functions", f"""
    select id, split_part(email, '@', 1) as local, split_part(email, '@', -1) as domain, case {' '.join(f"when regexp_matches(lower(split_part(email, '@', 1)), '{'|'.join(w)}') then '{n}'" for n, w in EMAIL_CATEGORIES)} else 'General' end as reader
    from emails where regexp_extract(source_url, '^https://([^/]*)', 1) = split_part(email, '@', -1)""")
def sql_scalar_functions(t):
    """Functions in a projection and a filter."""
    surface.register(t.spark, "email_local", "email_domain", "email_category", "url_domain")
    return t.spark.sql("select id, email_local(email) as local, email_domain(email) as domain, email_category(email) as reader from {emails} where url_domain(source_url) = email_domain(email)", emails=t.emails)


@query("sql_join_through_functions", """
    select c.id as company_id, count(*) as n from companies c join emails e on split_part(e.email, '@', -1) = regexp_extract(c.website, '^https?://([^/]*)', 1) group by c.id""")
def sql_join_through_functions(t):
    """Two tables that meet in what functions give."""
    surface.register(t.spark, "email_domain", "url_domain")
    return t.spark.sql("select c.id as company_id, count(*) as n from {companies} c join {emails} e on email_domain(e.email) = url_domain(c.website) group by c.id", companies=t.companies, emails=t.emails)


@query("sql_page_facts", f"select name, title, count(*) as n, count(distinct page_id) as pages from ({PERSON} from events) group by name, title")
def sql_page_facts(t):
    """The table function over pages, what it gives grouped by SQL."""
    register_page_facts(t.spark)
    pages = made(t, CARD).withColumn("seen", F.lit(True))
    return t.spark.sql("select name, title, count(*) as n, count(distinct page_id) as pages from (select distinct page_id, seen, name, title from page_facts(TABLE(select * from {pages}), 'cards')) group by name, title", pages=pages)
