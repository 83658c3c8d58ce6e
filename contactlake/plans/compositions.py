"""Queries that run whole jobs: scrape, discover, look up, start, benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactlake.engine import Engine
from contactlake.operators import directory as d
from contactlake.operators.keep import keep_first
from contactlake.operators.sampling import stride_sample

from .registry import query
from .relational import BENCH, CLEAN_PEOPLE
from .resolution import halves, rule
from .scalar import VERDICT

SCRAPED = f"""
    with todo as (select company_id, pages_checked from scrapes where company_id % 2 <> 0), v as ({VERDICT}),
      oe as (select company_id, email, verdict from found_emails where ord % 2 = 0 qualify row_number() over (partition by company_id, email order by ord) = 1),
      ne as (select distinct company_id, email from found_emails join todo using (company_id) where ord % 2 <> 0),
      e as (select company_id, email, coalesce(v.verdict, oe.verdict) as verdict from ne join v using (email) full join oe using (company_id, email)),
      nh as (select company_id, phone from found_phones join todo using (company_id) where ord % 2 <> 0 and regexp_matches(phone, '[0-9]') qualify row_number() over (partition by company_id, regexp_replace(phone, '[^0-9]', '', 'g') order by ord) = 1),
      h as (select company_id, phone from found_phones where ord % 2 = 0 and phone <> 'ext.' union select company_id, phone from nh),
      o as (select company_id, network from found_socials where ord % 2 = 0 union select company_id, network from found_socials join todo using (company_id) where ord % 2 <> 0),
      fp as (select * from found_people join todo using (company_id) where ord % 2 <> 0), np as ({CLEAN_PEOPLE.replace('{found}', 'fp')}),
      wp as (select company_id, name from web_people join todo using (company_id) where company_id not in (select company_id from np) qualify row_number() over (partition by company_id, lower(name) order by ord) = 1),
      p as (select company_id, name from found_people where ord % 2 = 0 union select company_id, name from np union select company_id, name from wp),
      n as (select company_id, count(*) as n from ne group by company_id)
    select s.company_id, s.company_id % 2 = 0 as cached, case when s.company_id % 2 = 0 then s.status when s.pages_checked = 0 then 'failed' when coalesce(n.n, 0) > 0 then 'ok' else 'partial' end as status,
      (select count(*) from e where e.company_id = s.company_id) as n_emails, (select count(*) from e where e.company_id = s.company_id and verdict = 'deliverable') as n_deliverable,
      (select count(*) from h where h.company_id = s.company_id) as n_phones, (select count(*) from p where p.company_id = s.company_id) as n_people, (select count(*) from o where o.company_id = s.company_id) as n_socials
    from scrapes s left join n on n.company_id = s.company_id"""


@query("pipeline_scrape_company", SCRAPED)
def pipeline_scrape_company(t):
    """Cached results stay; the others are scraped, filled from open sources where no people are found, verified, merged and read back."""
    old_e, new_e = halves(t.found_emails)
    old_p, new_p = halves(t.found_people)
    old_h, new_h = halves(t.found_phones)
    old_s, new_s = halves(t.found_socials)
    people = keep_first(old_p, ["company_id", "name"])
    before = Engine({
        "companies": t.companies,
        "emails": keep_first(old_e, ["company_id", "email"]).drop("ord"),
        "people": people.select(*[c for c in people.columns if c != "ord"]),
        "phones": keep_first(old_h.where("phone <> 'ext.'"), ["company_id", "phone"]).drop("ord"),
        "socials": keep_first(old_s, ["company_id", "network"]).drop("ord"),
        "scrapes": t.scrapes.where("company_id % 2 = 0").select("company_id", "status", "pages_checked"),
    })
    after = before.scrape(t.scrapes.select("company_id", "pages_checked"), {"emails": new_e, "people": new_p, "phones": new_h, "socials": new_s}, t.web_people, t.mx, t.smtp, t.catchall)
    rows = after.scrapes.select(F.col("company_id").alias("id"), "status").join(before.scrapes.select(F.col("company_id").alias("id"), F.lit(True).alias("was")), "id", "left")
    none = F.lit(0).cast("long")
    emails = after.emails.groupBy(F.col("company_id").alias("id")).agg(F.count("*").alias("n_emails"), F.count_if(F.col("verdict") == "deliverable").alias("n_deliverable"))
    told = d.with_counts(rows, phones=after.phones, people=after.people, socials=after.socials).join(emails, "id", "left")
    return told.select(F.col("id").alias("company_id"), F.coalesce("was", F.lit(False)).alias("cached"), "status", F.coalesce("n_emails", none).alias("n_emails"), F.coalesce("n_deliverable", none).alias("n_deliverable"), "n_phones", "n_people", "n_socials")


DOMAIN = "regexp_replace(regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', ''), '^m\\.', '')"
DISCOVERED = f"""
    with k as (select name, domain, 0 as stage, id as ord from companies where id % 50 = 0), f as (select {DOMAIN} as domain, title, query_ord * 1000000 + rank as ord from search_results),
      u as (select domain, name as title, stage, ord, true as trusted from k union all select domain, title, 1, ord, false from f where contains(domain, '.') and domain <> 'example.net' and not ends_with(domain, '.example.net')),
      r as (select * from u qualify row_number() over (partition by domain order by stage, ord) = 1),
      n as (select r.*, case when len(x) between 3 and 60 and contains(x, ' ') then x else array_to_string(list_transform(string_split(replace(replace(split_part(domain, '.', 1), '-', ' '), '_', ' '), ' '), lambda w: concat(upper(w[1]), lower(w[2:]))), ' ') end as name
            from (select *, trim(split_part(split_part(split_part(title, ' - ', 1), ' | ', 1), ' – ', 1)) as x from r) r),
      c as (select 0 as id, name, domain, trusted from n),
      j as (select c.*, h.title as home, exists (select 1 from companies x where x.domain = c.domain) as known, exists (select 1 from blocklist e where {rule('c', 'e')}) as hit from c left join site_homes h on h.domain = c.domain)
    select domain, name, case when not trusted and (home is null or home <> 'Fleet Vehicle Home') then 'rejected' when known then 'known' when hit then 'suppressed' else 'new' end as outcome,
      known or (not hit and (trusted or coalesce(home = 'Fleet Vehicle Home', false))) as listed from j"""


@query("pipeline_discover_country", DISCOVERED)
def pipeline_discover_country(t):
    """Sources merged, homes judged, known and suppressed domains told apart, the rest added to the directory."""
    engine = Engine({"companies": t.companies, "blocklist": t.blocklist})
    results = t.search_results.select((F.col("query_ord") * 1_000_000 + F.col("rank")).alias("ord"), "title", "url")
    trusted = t.companies.where("id % 50 = 0").select("id", "name", "domain")
    found = engine.discover(results, homes=t.site_homes, trusted=trusted.withColumnRenamed("id", "ord"), block=["example.net"]).where("outcome <> 'blocked'")
    after = engine.with_discovered(found, "Kenya").companies.select("domain", F.lit(True).alias("l")).dropDuplicates(["domain"])
    return found.join(after, "domain", "left").select("domain", "name", "outcome", F.coalesce("l", F.lit(False)).alias("listed"))


@query("pipeline_lookup", f"""
    with q as (select id as qid, case when id % 2 = 0 then upper(name) else concat(name, ' X') end as q, id from companies),
      g as (select company_id, domain, score from (select company_id, domain, pos, (case when contains(lower(coalesce(title, '')), 'customer') or contains(lower(coalesce(title, '')), substr(name, 10)) then 2 else 0 end) + (case when domain like '%.com' then 1 when domain like '%.io' or domain like '%.ai' then 0.5 else 0 end) as score from domain_probes) a
        qualify row_number() over (partition by company_id order by score desc, pos) = 1),
      c as (select qid as id, q as name, g.domain from q left join g on g.company_id = q.id),
      j as (select c.*, exists (select 1 from companies x where lower(x.name) = lower(c.name)) as known, exists (select 1 from blocklist e where {rule('c', 'e')}) as hit from c)
    select id as query_id, case when known then 'existing' when domain is null then 'unresolved' when hit then 'blocked' else 'added' end as outcome, case when not known then domain end as domain from j""")
def pipeline_lookup(t):
    """Names by the directory, else by the best of the guessed domains that answer; blocked ones aren't added."""
    q = t.companies.selectExpr("id as query_id", "case when id % 2 = 0 then upper(name) else concat(name, ' X') end as q")
    probes = t.domain_probes.withColumnRenamed("company_id", "query_id")
    return Engine({"companies": t.companies, "blocklist": t.blocklist}).lookups(q, probes).select("query_id", "outcome", "domain")


def seeds_sql() -> str:
    from contactlake.sources.seed import DIRECTORY

    from .crawl import literal

    return "(values " + ", ".join(f"({literal(r[0])}, {literal(r[1])})" for r in DIRECTORY) + ") v(name, domain)"


@query("pipeline_startup", f"""
    with c as (select id, name, domain, blocked from companies union all select null, name, domain, false from {seeds_sql()} where domain not in (select domain from companies)),
      kept as (select * from blocklist where lower(name) not in ('customer#000000007', 'customer#000000014'))
    select domain, blocked or exists (select 1 from kept e where {rule('c', 'e')}) as blocked from c""")
def pipeline_startup(t):
    """Seed the directory, clear the legacy entries, apply the blocklist."""
    engine = Engine({"companies": t.companies, "blocklist": t.blocklist}).start(("Customer#000000007", "customer#000000014 "))
    return engine.companies.select("domain", "blocked")


STRIDE = """
    select id from (select id, row_number() over (order by country, employees desc nulls last, id) - 1 as i, count(*) over () as n from companies where not blocked) r where i % greatest(1, n // 24) = 0 and i // greatest(1, n // 24) < 24
    union select id from companies where not blocked and domain in ('c1.example.com', 'c2.example.com')"""


@query("pipeline_bench", BENCH.replace("{scrapes}", f"(select * from scrapes where company_id in ({STRIDE}))"))
def pipeline_bench(t):
    """The totals of a strided sample of the directory and a few companies by name."""
    live = d.filtered(t.companies)
    strided = stride_sample(live, [F.col("country"), F.col("employees").desc_nulls_last(), F.col("id")], 24).select("id")
    sample = strided.unionByName(live.where(F.col("domain").isin("c1.example.com", "c2.example.com")).select("id")).distinct().withColumnRenamed("id", "company_id")
    return d.bench_totals(t.scrapes.join(sample, "company_id", "left_semi"), t.scrape_times, t.emails, t.phones, t.people, t.socials)
