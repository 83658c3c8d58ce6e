"""Queries over the directory: scans, filters, joins, aggregates, windows, sorts, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from contactlake.operators import directory as d
from contactlake.functions.names import STOP
from contactlake.functions.values import TITLE_BLOCKLIST, TITLE_WORDS
from contactlake.operators.keep import digits, keep_first, keep_last, mode_first_seen, ranked
from contactlake.operators.scrape import Totals, clean_people
from contactlake.streaming.worker import folder

from .registry import query


def words(listed) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in listed)


# scans


@query("scan_table", "select id, name, domain, country, category, employees, founded, blocked from companies")
def scan_table(t):
    return t.companies.select("id", "name", "domain", "country", "category", "employees", "founded", "blocked")


@query("scan_point_lookup", "select id, name, domain from companies where domain = 'c7.example.com'")
def scan_point_lookup(t):
    return t.companies.where(F.col("domain") == "c7.example.com").limit(1).select("id", "name", "domain")


@query("scan_ci_lookup", "select id, name from companies where lower(name) = lower('CUSTOMER#000000011') or lower(domain) = lower('C12.Example.Com')")
def scan_ci_lookup(t):
    return t.companies.where((F.lower("name") == F.lower(F.lit("CUSTOMER#000000011"))) | (F.lower("domain") == F.lower(F.lit("C12.Example.Com")))).select("id", "name")


@query("source_pages", "select page_id, url, length(html)::bigint as n from pages where html is not null and url is not null")
def source_pages(t):
    return t.pages.where("html is not null and url is not null").select("page_id", "url", F.length("html").cast("long").alias("n"))


@query("source_search_results", """
    select query_ord, rank, title, url from (select *, min(provider) over (partition by query_ord) as best from search_results) s where provider = best""")
def source_search_results(t):
    # a query with very many results is counted before it moves; its rows stay where they lie
    best = t.search_results.groupBy("query_ord").agg(F.min("provider").alias("provider"))
    return t.search_results.join(best, ["query_ord", "provider"], "left_semi").select("query_ord", "rank", "title", "url")


@query("source_sparql", """
    select distinct name, regexp_replace(regexp_replace(regexp_extract(lower(website), '^[a-z]+://([^/?#]*)', 1), '^www\\.', ''), '^m\\.', '') as domain
    from companies where website is not null and website <> '' and name not like 'Q%'""")
def source_sparql(t):
    from contactlake.functions.url import url_domain

    return t.companies.where("website is not null and website <> '' and name not like 'Q%'").select("name", url_domain(F.col("website")).alias("domain")).distinct()


@query("source_mx", "select domain, host, pref from (select *, row_number() over (partition by domain order by pref, host) as rn from mx) m where rn <= 3")
def source_mx(t):
    return ranked(t.mx, ["domain"], [F.col("pref"), F.col("host")], 3).select("domain", "host", "pref")


@query("source_smtp", """
    select email, case when refused then 'blocked' when code in (250, 251, 252) then 'deliverable' when code between 500 and 599 then 'rejected' else 'unknown' end as smtp_status from smtp""")
def source_smtp(t):
    from contactlake.functions.email import smtp_class

    return t.smtp.select("email", smtp_class(F.col("code"), F.col("refused")).alias("smtp_status"))


@query("source_kv_settings", """
    select cast(least(15, greatest(1, coalesce(max(case when key = 'max_pages' then try_cast(value as int) end), 10))) as int) as max_pages,
           least(10.0, greatest(0.0, coalesce(max(case when key = 'request_delay' then try_cast(value as double) end), 1.0)))::double as request_delay,
           cast(least(30, greatest(2, coalesce(max(case when key = 'smtp_timeout' then try_cast(value as int) end), 8))) as int) as smtp_timeout,
           cast(least(20, greatest(1, coalesce(max(case when key = 'max_candidates' then try_cast(value as int) end), 5))) as int) as max_candidates,
           coalesce(max(case when key = 'verify_emails' then value end), 'false') in ('1', 'true', 'yes') as verify_emails
    from settings""")
def source_kv_settings(t):
    from contactlake.sources.settings import effective

    return effective(t.settings)


@query("project_clamp", """
    select event_id, least(10.0, greatest(0.0, value))::double as delay, cast(least(15, greatest(1, user_id)) as bigint) as pages from events""")
def project_clamp(t):
    return t.events.select("event_id", F.least(F.lit(10.0), F.greatest(F.lit(0.0), "value")).alias("delay"), F.least(F.lit(15).cast("long"), F.greatest(F.lit(1).cast("long"), "user_id")).alias("pages"))


# filters and projections


@query("filter_conjunction", "select id, name from companies where not blocked and country = 'NATION_3' and category = 'BUILDING' and (name ilike '%1%' or domain ilike '%1%' or coalesce(city, '') ilike '%1%' or category ilike '%1%')")
def filter_conjunction(t):
    return d.filtered(t.companies, "NATION_3", "BUILDING", "1").select("id", "name")


@query("filter_like_any", "select id, city from companies where not blocked and (name ilike '%cItY1%' or domain ilike '%cItY1%' or city ilike '%cItY1%' or category ilike '%cItY1%')")
def filter_like_any(t):
    return d.filtered(t.companies, q="cItY1").select("id", "city")


@query("filter_like_two", "select id from companies where not blocked and (name ilike '%c_3%' or domain ilike '%c_3%')")
def filter_like_two(t):
    return d.filtered(t.companies, q="c_3", columns=("name", "domain")).select("id")


@query("filter_in_list", "select company_id, status from scrapes where status in ('ok', 'partial')")
def filter_in_list(t):
    return t.scrapes.where(F.col("status").isin("ok", "partial")).select("company_id", "status")


FINAL = ("deliverable", "rejected", "catchall", "invalid", "disposable")


@query("filter_not_in_or_null", "select id, email, verdict from emails where verdict is null or verdict not in ('deliverable', 'rejected', 'catchall', 'invalid', 'disposable')")
def filter_not_in_or_null(t):
    return t.emails.where(F.col("verdict").isNull() | ~F.col("verdict").isin(*FINAL)).select("id", "email", "verdict")


@query("filter_is_not_null", "select id, name, email from people where email is not null and smtp_status is null")
def filter_is_not_null(t):
    return t.people.where("email is not null and smtp_status is null").select("id", "name", "email")


@query("filter_neq", "select id, country from companies where country <> 'NATION_0'")
def filter_neq(t):
    return t.companies.where(F.col("country") != "NATION_0").select("id", "country")


@query("project_default", "select id, case when website is null or website = '' then concat('https://www.', domain) else website end as website from companies")
def project_default(t):
    return d.with_website(t.companies).select("id", "website")


@query("project_case_status", """
    select s.company_id, case when pages_checked = 0 then 'failed' when coalesce(n, 0) > 0 then 'ok' else 'partial' end as status
    from scrapes s left join (select company_id, count(*) as n from emails group by company_id) e on s.company_id = e.company_id""")
def project_case_status(t):
    n = d.counts_by_company(t.emails, "n")
    status = F.when(F.col("pages_checked") == 0, "failed").when(F.coalesce("n", F.lit(0)) > 0, "ok").otherwise("partial")
    return t.scrapes.join(n, "company_id", "left").select("company_id", status.alias("status"))


@query("project_person_initials", "select id, upper(concat(substr(split_part(name, ' ', 1), 1, 1), substr(split_part(name, ' ', 2), 1, 1))) as initials from people")
def project_person_initials(t):
    from contactlake.functions.names import initials

    return t.people.select("id", initials(F.col("name")).alias("initials"))


@query("project_fmt_employees", """
    select id, case when employees is null or employees = 0 then '—' when employees >= 1000 then
           case when employees % 1000 = 0 then concat(cast(employees // 1000 as varchar), 'k') else concat(cast(((employees + 50) // 100) // 10 as varchar), '.', cast(((employees + 50) // 100) % 10 as varchar), 'k') end
           else cast(employees as varchar) end as label from companies""")
def project_fmt_employees(t):
    from contactlake.functions.text import employees_label

    return t.companies.select("id", employees_label(F.col("employees")).alias("label"))


@query("project_rel_time", """
    select id, case when s < 60 then 'just now' when s < 3600 then concat(cast(s // 60 as varchar), 'm ago') when s < 86400 then concat(cast(s // 3600 as varchar), 'h ago') else strftime(ts, '%Y-%m-%d') end as label
    from (select id, ts, date_sub('second', ts, (select max(ts) from worker_log)) as s from worker_log) x""")
def project_rel_time(t):
    from contactlake.functions.text import relative_time

    now = t.worker_log.agg(F.max("ts").alias("now"))
    return t.worker_log.select("id", "ts").join(F.broadcast(now)).select("id", relative_time(F.col("ts"), F.col("now")).alias("label"))


@query("project_elapsed", "select event_id, case when user_id < 60 then concat(cast(user_id as varchar), 's') else concat(cast(user_id // 60 as varchar), 'm ', cast(user_id % 60 as varchar), 's') end as label from events")
def project_elapsed(t):
    from contactlake.functions.text import elapsed_label

    return t.events.select("event_id", elapsed_label(F.col("user_id")).alias("label"))


@query("project_flag_emoji", "select distinct country, concat(chr(127397 + ascii(substr(country, 1, 1))), chr(127397 + ascii(substr(country, 2, 1)))) as flag from companies")
def project_flag_emoji(t):
    from contactlake.functions.text import flag_emoji

    return t.companies.select("country").distinct().select("country", flag_emoji(F.col("country")).alias("flag"))


@query("project_page_count", "select country, greatest(1, ceil(count(*) / 24.0))::bigint as pages from companies group by country")
def project_page_count(t):
    return t.companies.groupBy("country").agg(d.page_count(F.count("*"), 24).alias("pages"))


# joins


@query("join_inner_fact_dim", "select e.id, e.email, c.name, c.country from emails e join companies c on c.id = e.company_id where not c.blocked")
def join_inner_fact_dim(t):
    c = t.companies.where(~F.col("blocked")).select(F.col("id").alias("company_id"), "name", "country")
    return t.emails.select("id", "email", "company_id").join(c, "company_id").select("id", "email", "name", "country")


@query("join_scalar_subquery_count", """
    select c.id, (select count(*) from emails e where e.company_id = c.id) as n_emails, (select count(*) from phones p where p.company_id = c.id) as n_phones,
           (select count(*) from people p where p.company_id = c.id) as n_people, (select count(*) from socials s where s.company_id = c.id) as n_socials
    from companies c where not c.blocked""")
def join_scalar_subquery_count(t):
    return d.with_counts(t.companies.where(~F.col("blocked")).select("id"), emails=t.emails, phones=t.phones, people=t.people, socials=t.socials)


@query("join_anti_not_in", "select id, name from companies where not blocked and id not in (select company_id from scrapes)")
def join_anti_not_in(t):
    return d.without(d.filtered(t.companies), t.scrapes).select("id", "name")


@query("join_anti_zero_count", "select id, name from companies c where not blocked and (select count(*) from people p where p.company_id = c.id) = 0")
def join_anti_zero_count(t):
    return d.without(d.filtered(t.companies), t.people).select("id", "name")


HOST = "regexp_extract(lower(url), '://([^/?#]*)', 1)"


@query("join_exists_dedupe", f"""
    with found as (select distinct {HOST} as domain from search_results union select 'c5.example.com' union select 'c6.example.com')
    select domain, exists (select 1 from companies c where c.domain = found.domain) as known from found""")
def join_exists_dedupe(t):
    found = t.search_results.select(F.regexp_extract(F.lower("url"), "://([^/?#]*)", 1).alias("domain")).unionByName(t.spark.createDataFrame([("c5.example.com",), ("c6.example.com",)], "domain string")).distinct()
    known = t.companies.select("domain").distinct()
    return found.join(known, "domain", "left_semi").withColumn("known", F.lit(True)).unionByName(found.join(known, "domain", "left_anti").withColumn("known", F.lit(False)))


# aggregates


@query("agg_count_star", "select count(*) as n from companies where not blocked")
def agg_count_star(t):
    return d.filtered(t.companies).agg(F.count("*").alias("n"))


@query("agg_count_distinct", "select count(distinct country) as n from companies where not blocked")
def agg_count_distinct(t):
    return d.filtered(t.companies).agg(F.count_distinct("country").alias("n"))


@query("agg_facet_country", "select country, country_code, count(*) as c from companies where not blocked group by all order by c desc, country")
def agg_facet_country(t):
    return d.facet(t.companies, "country", "country_code").orderBy(F.col("c").desc(), "country")


@query("agg_facet_category", "select category, count(*) as c from companies where not blocked group by all order by c desc, category")
def agg_facet_category(t):
    return d.facet(t.companies, "category").orderBy(F.col("c").desc(), "category")


@query("agg_having_min", "select country, count(*) as c from companies where country <> 'Unknown' group by country having count(*) < 65 order by c, country limit 1")
def agg_having_min(t):
    return t.companies.where(F.col("country") != "Unknown").groupBy("country").agg(F.count("*").alias("c")).where("c < 65").orderBy("c", "country").limit(1)


DASHBOARD = """
    with live as (select * from companies where not blocked),
         e as (select e.* from emails e join live on live.id = e.company_id), p as (select p.* from people p join live on live.id = p.company_id)
    select (select count(*) from live) as companies, (select count(distinct country) from live) as countries, (select count(*) from e) as emails,
           (select count(*) from phones h join live on live.id = h.company_id) as phones, (select count(*) from p) as people,
           (select count(*) from scrapes s join live on live.id = s.company_id where status in ('ok', 'partial')) as scraped_companies,
           (select count(*) from e where verdict = 'deliverable') + (select count(*) from p where email_status = 'verified') as verified,
           (select count(*) from p where email_status = 'pattern-derived') as derived,
           (select count(*) from companies where blocked) as blocked, (select count(*) from live where id not in (select company_id from scrapes)) as unscraped"""


@query("agg_stats_dashboard", DASHBOARD)
def agg_stats_dashboard(t):
    return d.dashboard(t.companies, t.emails, t.phones, t.people, t.scrapes)


@query("agg_sum_of_counts", "select (select count(*) from emails where verdict = 'deliverable') + (select count(*) from people where email_status = 'verified') as verified")
def agg_sum_of_counts(t):
    e = t.emails.agg(F.count_if(F.col("verdict") == "deliverable").alias("a"))
    p = t.people.agg(F.count_if(F.col("email_status") == "verified").alias("b"))
    return d.one_row(e, p).select((F.col("a") + F.col("b")).alias("verified"))


@query("agg_snapshot", """
    with live as (select * from companies where not blocked),
         e as (select e.* from emails e join live on live.id = e.company_id), p as (select p.* from people p join live on live.id = p.company_id),
         k as (select (select count(*) from live) as companies, (select count(distinct country) from live) as countries, (select count(*) from p) as people, (select count(*) from p where email_status = 'verified') as verified_people,
           (select count(*) from p where email_status = 'pattern-derived') as derived_people, (select count(*) from p where email_status = 'published') as published_people, (select count(*) from e) as emails,
           (select count(*) from e where verdict = 'deliverable') as verified_emails, (select count(*) from live where id not in (select company_id from scrapes)) as unscraped,
           (select count(*) from live where id not in (select company_id from people)) as zero_people,
           (select count(*) from e where verdict is null or verdict not in ('deliverable', 'rejected', 'catchall', 'invalid', 'disposable')) as pending_verify)
    select *, to_json({'scrape_remaining': unscraped, 'people_remaining': zero_people, 'verify_remaining': pending_verify})::varchar as pipeline from k""")
def agg_snapshot(t):
    return d.snapshot(t.companies, t.emails, t.people, t.scrapes, FINAL).withColumn("pipeline", F.to_json("pipeline"))


VERDICTS = ("deliverable", "catchall", "mx-ok", "rejected", "blocked", "invalid", "disposable")


@query("agg_verdict_summary", """
    select v.verdict, count(e.id) as n from (values ('deliverable'), ('catchall'), ('mx-ok'), ('rejected'), ('blocked'), ('invalid'), ('disposable')) v(verdict)
    left join emails e on e.verdict = v.verdict group by v.verdict""")
def agg_verdict_summary(t):
    n = t.emails.groupBy("verdict").agg(F.count("*").alias("n"))
    known = t.spark.createDataFrame([(v,) for v in VERDICTS], "verdict string")
    return known.join(n, "verdict", "left").select("verdict", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("agg_majority_domain", """
    select company_id, value, n from (select company_id, event as value, n, row_number() over (partition by company_id order by n desc, first) as rn
      from (select company_id, split_part(email, '@', 2) as event, count(*) as n, min(id) as first from emails group by all) x) y where rn = 1""")
def agg_majority_domain(t):
    return mode_first_seen(t.emails, "company_id", F.split_part("email", F.lit("@"), F.lit(2)), "id")


BENCH = """
    select count(*) as n, count(*) filter (s.status = 'ok') as ok, count(*) filter (s.status = 'partial') as partial, count(*) filter (s.status = 'failed') as failed,
           round(100.0 * count(*) filter (s.status in ('ok', 'partial')) / count(*), 1)::double as success_rate, round(sum(seconds) / count(*), 3)::double as avg_seconds, sum(coalesce(e.n, 0))::bigint as emails, sum(coalesce(h.n, 0))::bigint as phones,
           sum(coalesce(p.n, 0))::bigint as people, sum(coalesce(p.profiles, 0))::bigint as linkedin_profiles, sum(coalesce(o.n, 0))::bigint as socials, sum(coalesce(p.derived, 0))::bigint as derived_emails
    from {scrapes} s join scrape_times using (company_id) left join (select company_id, count(*) as n from emails group by all) e on e.company_id = s.company_id left join (select company_id, count(*) as n from phones group by all) h on h.company_id = s.company_id
    left join (select company_id, count(*) as n, count(*) filter (linkedin_type = 'profile') as profiles, count(*) filter (email_status = 'pattern-derived') as derived from people group by all) p on p.company_id = s.company_id
    left join (select company_id, count(*) as n from socials group by all) o on o.company_id = s.company_id"""


@query("agg_bench_totals", BENCH.replace("{scrapes}", "scrapes"))
def agg_bench_totals(t):
    return d.bench_totals(t.scrapes, t.scrape_times, t.emails, t.phones, t.people, t.socials)


@query("agg_bench_observed", BENCH.replace("{scrapes}", "scrapes"))
def agg_bench_observed(t):
    """The same totals, counted while the scrape's facts are written."""
    totals, at = Totals(), folder(t.spark, "scrape")
    mine = lambda facts: facts.join(timed.select("company_id"), "company_id", "left_semi")
    timed = t.scrapes.join(t.scrape_times, "company_id")
    for kind, rows in {"scrapes": timed, **{k: mine(getattr(t, k)) for k in ("emails", "phones", "people", "socials")}}.items():
        totals.watch(kind, rows).write.parquet(f"{at}/{kind}")
    kinds = "n long, ok long, partial long, failed long, success_rate double, avg_seconds double, emails long, phones long, people long, linkedin_profiles long, socials long, derived_emails long"
    told = totals.total()
    return t.spark.createDataFrame([tuple(told[c.split()[0]] for c in kinds.split(", "))], kinds)


@query("agg_scrape_summary", "select count(*) filter (status <> 'failed') as processed, count(*) filter (status = 'failed') as failed, count(*) as total from scrapes")
def agg_scrape_summary(t):
    return t.scrapes.agg(F.count_if(F.col("status") != "failed").alias("processed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count("*").alias("total"))


@query("agg_count_per_fact_list", """
    select s.company_id, (select count(*) from emails e where e.company_id = s.company_id) as n_emails, (select count(*) from people e where e.company_id = s.company_id) as n_people from scrapes s""")
def agg_count_per_fact_list(t):
    return d.with_counts(t.scrapes.select(F.col("company_id").alias("id")), emails=t.emails, people=t.people).withColumnRenamed("id", "company_id")


@query("agg_cycle_counters", "select job, count(*) as n, count(*) filter (level = 'error') as errors from worker_log group by job")
def agg_cycle_counters(t):
    return t.worker_log.groupBy("job").agg(F.count("*").alias("n"), F.count_if(F.col("level") == "error").alias("errors"))


# windows


@query("dedupe_email_first", "select company_id, email, ord from (select *, row_number() over (partition by company_id, email order by ord) rn from found_emails) x where rn = 1")
def dedupe_email_first(t):
    return keep_first(t.found_emails, ["company_id", "email"]).select("company_id", "email", "ord")


@query("dedupe_phone_digits", """
    select company_id, phone, ord from (select *, row_number() over (partition by company_id, regexp_replace(phone, '[^0-9]', '', 'g') order by ord) rn from found_phones
    where regexp_replace(phone, '[^0-9]', '', 'g') <> '') x where rn = 1""")
def dedupe_phone_digits(t):
    rows = t.found_phones.withColumn("k", digits(F.col("phone"))).where("k <> ''")
    return keep_first(rows, ["company_id", "k"]).select("company_id", "phone", "ord")


@query("dedupe_social", "select company_id, network, url, ord from (select *, row_number() over (partition by company_id, network, split_part(url, '?', 1) order by ord) rn from found_socials) x where rn = 1")
def dedupe_social(t):
    return keep_first(t.found_socials.withColumn("k", F.split_part("url", F.lit("?"), F.lit(1))), ["company_id", "network", "k"]).select("company_id", "network", "url", "ord")


CLEAN_PEOPLE = f"""
    select company_id, name, ord from (select *, row_number() over (partition by company_id order by ord) as k from (select *, row_number() over (partition by company_id, lower(name) order by ord) as rn from (
      select p.company_id, p.name, p.ord, string_split(lower(p.name), ' ') as w, lower(coalesce(p.title, '')) as lt, p.email, lower(c.name) as cn from {{found}} p join companies c on c.id = p.company_id) a
      where not (length(name) < 3 or len(list_intersect(w, [{words(STOP)}])) > 0 or len(w) not between 2 and 4 or len(list_intersect(w, [{words(TITLE_WORDS)}])) > 0 or len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) > 0
        or (len(w) = 4 and w[1] = w[3] and w[2] = w[4]) or lower(name) = cn or (lt = '' and email is null) or len(list_filter([{words(TITLE_BLOCKLIST)}], lambda b: contains(lt, b))) > 0 or len(list_intersect(w, string_split(cn, ' '))) > 0)) x where rn = 1) y where k <= 60"""


@query("dedupe_person", CLEAN_PEOPLE.replace("{found}", "found_people"))
def dedupe_person(t):
    return clean_people(t.found_people, t.companies).select("company_id", "name", "ord")


@query("dedupe_first_domain", f"select domain, title from (select {HOST} as domain, title, row_number() over (partition by {HOST} order by query_ord, rank) rn from search_results) x where rn = 1")
def dedupe_first_domain(t):
    rows = t.search_results.withColumn("domain", F.regexp_extract(F.lower("url"), "://([^/?#]*)", 1))
    return ranked(rows, ["domain"], [F.col("query_ord"), F.col("rank")]).select("domain", "title")


@query("window_last_social", "select company_id, network, url from (select *, row_number() over (partition by company_id, network order by ord desc) rn from found_socials) x where rn = 1")
def window_last_social(t):
    return keep_last(t.found_socials, ["company_id", "network"]).select("company_id", "network", "url")


@query("window_log_retention", "select id, job from worker_log order by id desc limit 300")
def window_log_retention(t):
    return t.worker_log.orderBy(F.col("id").desc()).limit(300).select("id", "job")


@query("window_round_robin", """
    select e.event_id, n.n_name as country from events e join (select n_name, row_number() over (order by n_name) - 1 as i, count(*) over () as k from nation) n on e.event_id % n.k = n.i""")
def window_round_robin(t):
    pool = t.nation.groupBy().agg(F.array_sort(F.collect_list("n_name")).alias("pool"))  # one row: a fixed list of countries
    return t.events.join(F.broadcast(pool)).select("event_id", F.get("pool", F.pmod("event_id", F.size("pool")).cast("int")).alias("country"))


@query("window_first_deliverable", """
    select company_id, email, verdict from (select *, row_number() over (partition by company_id order by case verdict when 'deliverable' then 0 when 'catchall' then 1 else 2 end, id) rn
    from emails where verdict in ('deliverable', 'catchall', 'mx-ok')) x where rn = 1""")
def window_first_deliverable(t):
    from contactlake.functions.email import verdict_rank

    rows = t.emails.where(F.col("verdict").isin("deliverable", "catchall", "mx-ok"))
    return rows.groupBy("company_id").agg(F.min_by(F.struct("email", "verdict"), F.struct(verdict_rank(F.col("verdict")), "id")).alias("x")).select("company_id", "x.email", "x.verdict")


# sorts and limits


@query("sort_employees_page", "select id, name, employees from companies where not blocked order by employees desc nulls last, name, id limit 24 offset 48")
def sort_employees_page(t):
    return d.page(d.filtered(t.companies), 3, 24).select("id", "name", "employees")


@query("topk_unscraped", "select id, name from companies where not blocked and id not in (select company_id from scrapes) order by employees desc nulls last, name, id limit 2")
def topk_unscraped(t):
    return d.by_size(d.without(d.filtered(t.companies), t.scrapes)).limit(2).select("id", "name")


@query("topk_zero_people", "select id, name from companies where not blocked and id not in (select company_id from people) order by employees desc nulls last, name, id limit 2")
def topk_zero_people(t):
    return d.by_size(d.without(d.filtered(t.companies), t.people)).limit(2).select("id", "name")


@query("topk_bulk_enrich", "select id, name from companies where not blocked and category = 'MACHINERY' order by employees desc nulls last, name, id limit 500")
def topk_bulk_enrich(t):
    return d.by_size(d.filtered(t.companies, category="MACHINERY")).limit(500).select("id", "name")


@query("limit_unordered", "select id, email from emails where verdict is null or verdict not in ('deliverable', 'rejected', 'catchall', 'invalid', 'disposable') order by id limit 8")
def limit_unordered(t):
    return t.emails.where(F.col("verdict").isNull() | ~F.col("verdict").isin(*FINAL)).orderBy("id").limit(8).select("id", "email")


@query("sort_contacts", "select company_id, category, email from emails order by company_id, category, email")
def sort_contacts(t):
    return t.emails.select("company_id", "category", "email").orderBy("company_id", "category", "email")


@query("sort_log_tail", "select id, job, level, message, cast(json_extract_string(payload, '$.k') as bigint) as k from worker_log order by id desc limit 50")
def sort_log_tail(t):
    return t.worker_log.orderBy(F.col("id").desc()).limit(50).select("id", "job", "level", "message", F.get_json_object("payload", "$.k").cast("long").alias("k"))


@query("sample_stride", """
    with r as (select id, country, row_number() over (order by country, employees desc nulls last, id) - 1 as i, count(*) over () as n from companies where not blocked)
    select id, country from r where i % greatest(1, n // 24) = 0 and i // greatest(1, n // 24) < 24
    union select id, country from companies where not blocked and domain in ('c1.example.com', 'c2.example.com')""")
def sample_stride(t):
    from contactlake.operators.sampling import stride_sample

    live = d.filtered(t.companies)
    strided = stride_sample(live, [F.col("country"), F.col("employees").desc_nulls_last(), F.col("id")], 24)
    return strided.select("id", "country").unionByName(live.where(F.col("domain").isin("c1.example.com", "c2.example.com")).select("id", "country")).distinct()


# set operations


@query("union_all_verify_queue", "select 'email' as kind, id, email from emails where smtp_status is null union all select 'person', id, email from people where email is not null and smtp_status is null")
def union_all_verify_queue(t):
    a = t.emails.where("smtp_status is null").select(F.lit("email").alias("kind"), "id", "email")
    return a.unionByName(t.people.where("email is not null and smtp_status is null").select(F.lit("person").alias("kind"), "id", "email"))


EXPORT = """
    select ord, c.name as company, c.domain, c.country, c.category, type, value, detail, source_url from (
      select company_id, 1 as ord, 'email' as type, email as value, category as detail, source_url from emails
      union all select company_id, 2, 'phone', phone, label, source_url from phones union all select company_id, 3, 'person', name, title, null from people
      union all select company_id, 4, 'social', url, network, null from socials) f join companies c on c.id = f.company_id where not c.blocked"""


@query("union_contacts_export", EXPORT)
def union_contacts_export(t):
    return d.export_rows(t.companies, t.emails, t.phones, t.people, t.socials)


@query("sink_csv_export", EXPORT.replace("select ord, ", "select ", 1).replace("value, detail", "value, nullif(detail, '') as detail", 1))
def sink_csv_export(t):
    from contactlake.streaming.worker import folder

    path = folder(t.spark, "export")
    rows = d.export_rows(t.companies, t.emails, t.phones, t.people, t.socials)
    d.write_csv(rows, path)
    return d.read_csv(t.spark, rows.drop("ord").schema, path)


@query("set_distinct_countries", "select distinct country from companies")
def set_distinct_countries(t):
    return t.companies.select("country").distinct()


@query("set_difference_expansion", "select n_name as country from nation where n_name not in (select country from companies where not blocked and employees > 9900)")
def set_difference_expansion(t):
    have = t.companies.where("not blocked and employees > 9900").select(F.col("country").alias("n_name"))
    return t.nation.select("n_name").join(have, "n_name", "left_anti").select(F.col("n_name").alias("country"))


@query("set_intersection_tokens", r"""
    select page_id, len(list_intersect(list_distinct(regexp_extract_all(lower(url), '[a-z0-9]+')), ['example', 'com', 'en', 'ththth']))::bigint as n from pages""")
def set_intersection_tokens(t):
    from contactlake.functions.text import alnum_tokens

    return t.pages.select("page_id", F.size(F.array_intersect(alnum_tokens(F.col("url")), F.array(*map(F.lit, ("example", "com", "en", "ththth"))))).cast("long").alias("n"))


@query("map_last_table_wins", """
    select email, source from (select *, row_number() over (partition by email order by p desc) rn from (select distinct email, 'emails' as source, 1 as p from emails
    union all select distinct email, 'people', 2 from people where email is not null) x) y where rn = 1""")
def map_last_table_wins(t):
    both = t.emails.select("email", F.lit("emails").alias("source"), F.lit(1).alias("p")).unionByName(t.people.where("email is not null").select("email", F.lit("people").alias("source"), F.lit(2).alias("p")))
    return both.groupBy("email").agg(F.max_by("source", "p").alias("source"))


# orphans


@query("check_orphans", "select id, company_id from emails where company_id not in (select id from companies)")
def check_orphans(t):
    ids = t.companies.select(F.col("id").alias("company_id"))
    return t.emails.select("id", "company_id").join(ids, "company_id", "left_anti").select("id", "company_id")
