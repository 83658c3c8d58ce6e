"""Logical tables of the contact warehouse, bound to the physical test tables by SQL that Spark and DuckDB both run.

Names in braces are other tables. Columns that the physical tables lack are derived from keys, the same in both
engines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from contactlake.functions.values import GUESS_PATHS
from contactlake.operators.pages import spread


def _listed(*columns) -> str:
    """A literal table's rows."""
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in columns)


LOCS = ("/", "/about/", "/wp-content/team/", "/people/", "/our-team/#x", "/leadership", "/founder/notes", "/blog/tag/board/", "/team/data.xml", "/teams-evolve/", "/products/")
SITEMAP = "<urlset>" + "".join(f"<url><loc> @{p} </loc></url>" for p in LOCS) + "<url><loc>/who-we-are/</loc></url>"
HREFS = ("/about/", "/about/us", "/x/team", "/news#top", "/careers/jobs", "/shop/a", "https://other.example.com/team/", "/leadership", "/private/team/", "/contact")

BINDINGS = {
    "companies": """
        select c_custkey as id, c_name as name, concat('c', cast(c_custkey as varchar(20)), '.example.com') as domain,
               case c_custkey % 3 when 0 then '' when 1 then null else concat('https://c', cast(c_custkey as varchar(20)), '.example.com/') end as website,
               n_name as country, concat('N', cast(n_nationkey as varchar(20))) as country_code,
               case when c_custkey % 5 = 0 then null else concat('City', cast(c_custkey % 17 as varchar(20))) end as city,
               c_mktsegment as category, case when c_acctbal < 0 then null else cast(floor(c_acctbal) as int) end as employees,
               cast(1976 + c_custkey % 46 as int) as founded, c_custkey % 13 = 0 as blocked
        from {customer} join {nation} on c_nationkey = n_nationkey""",
    "found_emails": """
        select user_id as company_id, concat(event_type, '.', cast(event_id % 20 as varchar(20)), '@c', cast(user_id as varchar(20)), '.example.com') as email,
               case event_type when 'purchase' then 'Sales' when 'signup' then 'Support' else 'General' end as category,
               concat('https://c', cast(user_id as varchar(20)), '.example.com/p', cast(event_id % 7 as varchar(20))) as source_url,
               case event_type when 'purchase' then 'deliverable' when 'signup' then 'catchall' when 'view' then 'mx-ok' when 'error' then 'rejected' else null end as verdict,
               case event_type when 'purchase' then 'deliverable' when 'error' then 'rejected' when 'view' then 'unknown' else null end as smtp_status,
               case when event_id % 9 = 0 then null else 'ok' end as mx_status, event_id as ord
        from {events}""",
    "emails": """
        select ord as id, company_id, email, category, source_url, verdict, smtp_status, mx_status
        from (select *, row_number() over (partition by company_id, email order by ord) as rn from {found_emails}) t where rn = 1""",
    "scrapes": """
        select o_custkey as company_id, case o_orderstatus when 'O' then 'ok' when 'P' then 'partial' else 'failed' end as status,
               cast(o_orderkey % 11 as int) as pages_checked, o_orderdate as scraped_at
        from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from {orders} where o_orderpriority = '1-URGENT') t
        where rn = 1""",
    "found_people": """
        select o_custkey as company_id,
               concat(case o_orderkey % 5 when 0 then 'Ann' when 1 then 'Bob' when 2 then 'José' when 3 then 'Cleo' else 'Dmitri' end, ' ',
                      case o_orderkey % 4 when 0 then 'Lee' when 1 then 'Böckers' when 2 then 'Silva' else 'Novak' end) as name,
               case o_orderkey % 6 when 0 then 'CEO' when 1 then 'Sales Manager' when 2 then '' when 3 then null when 4 then 'Head of Data' else 'Director' end as title,
               case when o_orderkey % 3 = 0 then concat('p', cast(o_orderkey % 10 as varchar(20)), '@c', cast(o_custkey as varchar(20)), '.example.com') else null end as email,
               case o_orderpriority when '1-URGENT' then 'verified' when '2-HIGH' then 'pattern-derived' when '3-MEDIUM' then 'published' when '4-NOT SPECIFIED' then 'catchall' else null end as email_status,
               case when o_orderkey % 3 = 0 and o_orderkey % 4 <> 0 then 'deliverable' else null end as smtp_status,
               case when o_orderkey % 7 = 0 then concat('https://www.linkedin.com/in/x', cast(o_orderkey as varchar(20))) else concat('https://www.linkedin.com/search/results/', cast(o_orderkey % 50 as varchar(20))) end as linkedin_url,
               case when o_orderkey % 7 = 0 then 'profile' else 'search' end as linkedin_type,
               o_orderkey as ord
        from {orders} where o_custkey % 4 <> 3""",
    "people": """
        select ord as id, company_id, name, title, email, email_status, smtp_status, linkedin_url, linkedin_type
        from (select *, row_number() over (partition by company_id, name order by ord) as rn from {found_people}) t where rn = 1""",
    "found_phones": """
        select user_id as company_id,
               case event_id % 3 when 0 then concat('+1 (', cast(200 + event_id % 40 as varchar(20)), ') 555-', lpad(cast(event_id % 50 as varchar(20)), 4, '0'))
                    when 1 then concat('+1 ', cast(200 + event_id % 40 as varchar(20)), ' 555 ', lpad(cast(event_id % 50 as varchar(20)), 4, '0')) else 'ext.' end as phone,
               case when event_id % 4 = 0 then null else event_type end as label,
               concat('https://c', cast(user_id as varchar(20)), '.example.com/') as source_url, event_id as ord
        from {events}""",
    "phones": """
        select ord as id, company_id, phone, label, source_url
        from (select *, row_number() over (partition by company_id, phone order by ord) as rn from {found_phones} where phone <> 'ext.') t where rn = 1""",
    "found_socials": """
        select user_id as company_id, case event_id % 5 when 0 then 'linkedin' when 1 then 'x' when 2 then 'facebook' when 3 then 'youtube' else 'instagram' end as network,
               concat('https://social.example.com/', event_type, cast(event_id % 4 as varchar(20)), case when event_id % 2 = 0 then concat('?ref=', cast(event_id as varchar(20))) else '' end) as url,
               event_id as ord
        from {events}""",
    "socials": """
        select ord as id, company_id, network, url
        from (select *, row_number() over (partition by company_id, network order by ord desc) as rn from {found_socials}) t where rn = 1""",
    "blocklist": """
        select s_suppkey as id, concat('Customer#', lpad(cast(s_suppkey * 7 as varchar(20)), 9, '0')) as name,
               case when s_suppkey % 3 = 0 then concat('c', cast(s_suppkey * 11 as varchar(20)), '.example.com') else null end as domain
        from {supplier}""",
    "search_results": """
        select page_id % 5 as query_ord, case when page_id % 4 = 3 then 'second' else 'first' end as provider, page_id as rank,
               regexp_extract(html, '<title>([^<]*)</title>', 1) as title, url
        from {pages}""",
    "worker_log": """
        select event_id as id, ts, event_type as job, case when event_type = 'error' then 'error' else 'info' end as level,
               concat(event_type, ' by ', cast(user_id as varchar(20))) as message, props as payload
        from {events}""",
    "mx": """
        select domain, concat('mx', cast(k as varchar(20)), '.', domain) as host, cast((k * 7 + id) % 20 as int) as pref
        from (select distinct concat('c', cast(user_id as varchar(20)), '.example.com') as domain, user_id as id from {events}) d
        join (select 1 as k union all select 2 as k) two on 1 = 1 where id % 7 <> 0""",
    "smtp": """
        select email, cast(case event % 6 when 0 then 250 when 1 then 251 when 2 then 550 when 3 then 450 when 4 then 252 else 0 end as int) as code, event % 10 = 9 as refused
        from (select email, min(ord) as event from {found_emails} group by email) t""",
    "catchall": """
        select domain, case id % 4 when 0 then 'deliverable' when 1 then 'rejected' else 'unknown' end as probe
        from (select distinct concat('c', cast(user_id as varchar(20)), '.example.com') as domain, user_id as id from {events}) d""",
    "sitemaps": f"""
        select id as company_id, concat('https://', domain) as base,
               concat(replace('{SITEMAP}', '@', concat('https://', domain)), case when id % 3 = 0 then '<url><loc>/executive-board/</loc></url>' else '' end, '</urlset>') as xml
        from {{companies}}""",
    "fetches": f"""
        select id as company_id, concat('https://', domain) as base, path, case when (id + pos) % 3 = 0 then 404 else 200 end as status,
               case when (id + pos) % 5 = 0 then 'Error 404' when (id + pos) % 7 = 0 then 'Page Not Found' else 'About us' end as title
        from {{companies}} join (select * from (values {_listed(*((p, i) for i, p in enumerate(GUESS_PATHS)))}) v(path, pos)) g on 1 = 1""",
    "home_links": f"""
        select id as company_id, concat('https://', domain, '/') as base, href
        from {{companies}} join (select * from (values {_listed(*((h,) for h in HREFS))}) v(href)) h on 1 = 1""",
    "robots": """
        select id as company_id, case id % 5 when 1 then 403 when 2 then 404 else 200 end as status,
               case id % 5 when 0 then concat('User-agent: *', chr(10), 'Disallow: /private/', chr(10), 'Allow: /private/team/')
                    when 3 then concat('User-agent: otherbot', chr(10), 'Disallow: /', chr(10), chr(10), 'User-agent: *', chr(10), 'Allow: /about/', chr(10), 'Disallow: /about/us', chr(10), 'Disallow: /news')
                    when 4 then concat('User-agent: leads', chr(10), 'Disallow: /') end as body
        from {companies}""",
    "wiki_hits": """
        select id as company_id, name, pos, case when pos = 3 then name when pos = 4 then concat(name, ' Ltd') else title end as title
        from {companies} join (select * from (values (0, 'Customer (company)'), (1, 'Customer'), (2, 'Film'), (3, ''), (4, ''), (5, 'Corporation customer'), (6, 'Incas')) v(pos, title)) t on 1 = 1""",
    "domain_probes": """
        select id as company_id, name, pos, concat('customer', substr(name, 10), ext) as domain, case (id + pos) % 3 when 0 then 'Welcome to CUSTOMER' when 1 then 'Parked' end as title
        from {companies} join (select * from (values (0, '.com'), (1, '.io'), (2, '.co'), (3, '.net'), (4, '.ai')) v(pos, ext)) g on 1 = 1 where (id + pos) % 4 <> 0""",
    "wiki_redirects": """
        select page_id as source, case when page_id % 10 = 1 then page_id + 1 when page_id % 10 = 2 then page_id - 1 else page_id - 7 end as target
        from {pages} where page_id % 10 in (1, 2) or (page_id % 3 = 0 and page_id >= 7)""",
    "scrape_times": """
        select company_id, cast(company_id % 97 as double) / 10 as seconds from {scrapes}""",
    "web_people": """
        select o_custkey as company_id, concat('Eva ', case o_orderkey % 3 when 0 then 'Berg' when 1 then 'Costa' else 'Duarte' end) as name, 'CEO' as title, o_orderkey as ord
        from {orders} where o_orderkey % 2 = 0""",
    "site_homes": """
        select domain, case page_id % 3 when 0 then 'Fleet Vehicle Home' when 1 then 'Online dictionary' else 'Welcome' end as title, cast(null as varchar(20)) as meta, cast(null as varchar(20)) as body
        from (select regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www[.]', ''), '^m[.]', '') as domain, min(page_id) as page_id from {pages} group by 1) t where page_id % 7 <> 5""",
    "settings": """
        select 'max_pages' as key, '30' as value union all select 'request_delay', '-1.5' union all select 'smtp_timeout', 'abc'
        union all select 'verify_emails', 'true' union all select 'max_candidates', '7'""",
}

PHYSICAL = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "benchmark", "conversations", "embeddings")


#: Tables that make many rows of each of companies: these are dealt over all cores first, else one file's partition would make them all.
MULTIPLIED = ("sitemaps", "fetches", "home_links")


def _named(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


class Tables:
    """Tables of one directory by attribute; each is read or bound when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir, self._seen = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._seen:
            if name in PHYSICAL:
                self._seen[name] = self.spark.read.parquet(f"{self._dir}/{name}.parquet")
            elif name in BINDINGS:
                sql = BINDINGS[name]
                deal = spread if name in MULTIPLIED else lambda rows: rows
                self._seen[name] = self.spark.sql(sql, **{n: deal(getattr(self, n)) for n in _named(sql)})
            else:
                raise AttributeError(name)
        return self._seen[name]


def with_bindings(sql: str) -> str:
    """sql with the logical tables it names in front, for an engine that has the physical ones as views."""
    need: list[str] = []

    def add(name: str) -> None:
        if name in need:
            return
        for n in _named(BINDINGS[name]):
            if n in BINDINGS:
                add(n)
        need.append(name)

    for name in BINDINGS:
        if re.search(rf"\b(?:from|join)\s+{name}\b|,\s*{name}\b", sql, re.I):
            add(name)
    ctes = [f"{n} as ({re.sub(r'[{](\w+)[}]', r'\1', BINDINGS[n]).strip()})" for n in need]
    body = sql.strip()
    if not ctes:
        return body
    if body.lower().startswith("with recursive "):
        return f"with recursive {', '.join(ctes)}, {body[15:]}"
    if body.lower().startswith("with "):
        return f"with {', '.join(ctes)}, {body[5:]}"
    return f"with {', '.join(ctes)} {body}"
