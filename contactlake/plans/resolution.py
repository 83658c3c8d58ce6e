"""Queries of merges, suppression, conventions, verification and discovery."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from contactlake.functions import email, text, url
from contactlake.operators import blocklist as b
from contactlake.operators import resolve as r
from contactlake.operators.frontier import crawl_frontier as frontier
from contactlake.operators.keep import keep_first, ranked
from contactlake.operators.suppression import Suppression
from contactlake.sources.buckets import BucketedTable
from contactlake.streaming.worker import folder
from contactlake.operators.merge import coalesced, inserted, merged, new_value, non_empty

from .registry import query
from .scalar import FIRST, LAST, LINKS, PAGE_WORD, patterns_sql, quoted, verified

# merges: the first half of what was found is the old table, the rest the batch


def halves(df, k=2):
    return df.where(F.col("ord") % k == 0), df.where(F.col("ord") % k != 0)


def sides(table, keys, k=2):
    ks = ", ".join(keys)
    return f"""o as (select * from (select *, row_number() over (partition by {ks} order by ord) as rn from {table} where ord % {k} = 0) x where rn = 1),
               n as (select * from {table} where ord % {k} <> 0)"""


def last(c, keys, counts=f"is not null"):
    return f"(select x.{c} from n x where {' and '.join(f'x.{k} = q.{k}' for k in keys)} and x.{c} {counts} order by x.ord desc limit 1)"


def by_last(c, keys, cond="true"):
    """The last value of the batch under cond, per key."""
    return f"arg_max({c}, ord) filter ({cond})"


@query("merge_emails", f"""
    with {sides('found_emails', ['company_id', 'email'])}, k as (select company_id, email, arg_max(category, ord) as category, arg_max(source_url, ord) filter (source_url is not null) as source_url, arg_max(mx_status, ord) filter (mx_status is not null) as mx_status from n group by all)
    select coalesce(o.company_id, k.company_id) as company_id, coalesce(o.email, k.email) as email, case when k.email is null then o.category else k.category end as category,
           coalesce(k.source_url, o.source_url) as source_url, coalesce(k.mx_status, o.mx_status) as mx_status
    from o full join k on o.company_id = k.company_id and o.email = k.email""")
def merge_emails(t):
    old, new = halves(t.found_emails)
    keys = ["company_id", "email"]
    return merged(keep_first(old, keys), new, keys, {"category": new_value, "source_url": coalesced, "mx_status": coalesced}, "ord")


@query("sink_upsert", f"""
    with {sides('found_phones', ['company_id', 'phone'], 3)}, k as (select company_id, phone, arg_max(label, ord) filter (label is not null) as label, arg_max(source_url, ord) as source_url from n group by all)
    select coalesce(o.company_id, k.company_id) as company_id, coalesce(o.phone, k.phone) as phone, coalesce(k.label, o.label) as label, coalesce(k.source_url, o.source_url) as source_url from o full join k on o.company_id = k.company_id and o.phone = k.phone""")
def sink_upsert(t):
    """Into a stored table, of which only the batch's buckets are written anew."""
    old, new = halves(t.found_phones, 3)
    keys, policies = ["company_id", "phone"], {"label": coalesced, "source_url": coalesced}
    table = BucketedTable(t.spark, folder(t.spark, "phones"), "company_id long, phone string, label string, source_url string", keys, ["company_id"], 16)
    table.upsert(keep_first(old, keys), policies)
    table.upsert(new, policies, "ord")
    return table.read()


@query("merge_phones", f"""
    with {sides('found_phones', ['company_id', 'phone'])}, k as (select company_id, phone, arg_max(label, ord) filter (label is not null) as label, arg_max(source_url, ord) as source_url from n group by all)
    select coalesce(o.company_id, k.company_id) as company_id, coalesce(o.phone, k.phone) as phone, coalesce(k.label, o.label) as label, coalesce(k.source_url, o.source_url) as source_url from o full join k on o.company_id = k.company_id and o.phone = k.phone""")
def merge_phones(t):
    old, new = halves(t.found_phones)
    keys = ["company_id", "phone"]
    return merged(keep_first(old, keys), new, keys, {"label": coalesced, "source_url": coalesced}, "ord")


@query("merge_socials", f"""
    with {sides('found_socials', ['company_id', 'network'])}, k as (select company_id, network, arg_max(url, ord) as url from n group by all)
    select coalesce(o.company_id, k.company_id) as company_id, coalesce(o.network, k.network) as network, coalesce(k.url, o.url) as url from o full join k on o.company_id = k.company_id and o.network = k.network""")
def merge_socials(t):
    old, new = halves(t.found_socials)
    keys = ["company_id", "network"]
    return merged(keep_first(old, keys), new, keys, {"url": new_value}, "ord")


def profile_only(new, old):
    return F.coalesce(new, old)


@query("merge_people", f"""
    with {sides('found_people', ['company_id', 'name'])},
      k as (select company_id, name, coalesce(arg_max(title, ord) filter (title <> ''), '') as title, arg_max(email, ord) filter (email is not null) as email, arg_max(email_status, ord) filter (email_status is not null) as email_status,
              arg_max(linkedin_url, ord) filter (linkedin_type = 'profile') as link, arg_max(linkedin_url, ord) as any_link, arg_max(linkedin_type, ord) as any_type from n group by all)
    select coalesce(o.company_id, k.company_id) as company_id, coalesce(o.name, k.name) as name, case when o.name is null then nullif(k.title, '') when k.name is null then nullif(o.title, '') else coalesce(nullif(k.title, ''), nullif(o.title, '')) end as title, coalesce(k.email, o.email) as email,
           coalesce(k.email_status, o.email_status) as email_status, case when o.name is null then coalesce(k.link, k.any_link) else coalesce(k.link, o.linkedin_url) end as linkedin_url,
           case when k.link is not null then 'profile' when o.name is null then k.any_type else o.linkedin_type end as linkedin_type
    from o full join k on o.company_id = k.company_id and o.name = k.name""")
def merge_people(t):
    old, new = halves(t.found_people)
    keys = ["company_id", "name"]
    # a link counts only if it is a profile; else the old one stays, or for a new person whatever came last
    profile = F.col("linkedin_type") == "profile"
    batch = new.withColumn("link", F.when(profile, F.col("linkedin_url"))).withColumn("title", F.nullif("title", F.lit("")))
    old = keep_first(old, keys).withColumn("link", F.lit(None).cast("string")).withColumn("title", F.nullif("title", F.lit("")))
    first_type = lambda n, o: F.when(o.isNull(), n).otherwise(o)
    out = merged(old, batch, keys, {"title": non_empty, "email": coalesced, "email_status": coalesced, "link": coalesced, "linkedin_url": first_type, "linkedin_type": first_type}, "ord")
    return out.select(*keys, "title", "email", "email_status", F.coalesce("link", "linkedin_url").alias("linkedin_url"), F.when(F.col("link").isNotNull(), "profile").otherwise(F.col("linkedin_type")).alias("linkedin_type"))


@query("merge_scrapes", """
    select company_id, status, pages_checked from (select company_id, status, pages_checked, row_number() over (partition by company_id order by p desc) as rn
      from (select *, 0 as p from scrapes union all select *, 1 as p from (select company_id + 1 as company_id, 'ok' as status, cast(9 as int) as pages_checked, scraped_at from scrapes where company_id % 3 = 0) z) y) x where rn = 1""")
def merge_scrapes(t):
    new = t.scrapes.where("company_id % 3 = 0").select((F.col("company_id") + 1).alias("company_id"), F.lit("ok").alias("status"), F.lit(9).alias("pages_checked"))
    return merged(t.scrapes, new, ["company_id"], {"status": new_value, "pages_checked": new_value})


@query("merge_kv", "select key, case key when 'max_pages' then '12' else value end as value from settings union all select 'theme', 'dark'")
def merge_kv(t):
    new = t.spark.createDataFrame([("max_pages", "12"), ("theme", "dark")], "key string, value string")
    return merged(t.settings, new, ["key"], {"value": new_value})


@query("merge_insert_ignore", "select id, name from blocklist union all select 9001, 'New Entry'")
def merge_insert_ignore(t):
    new = t.spark.createDataFrame([(9001, "New Entry"), (9002, "Customer#000000007")], "id long, name string")
    return inserted(t.blocklist.select("id", "name"), new, ["name"])


@query("merge_never_delete", "select cast(0 as bigint) as lost")
def merge_never_delete(t):
    old, new = halves(t.found_emails)
    keys = ["company_id", "email"]
    after = merged(keep_first(old, keys), new, keys, {"category": new_value}, "ord")
    return old.select(*keys).distinct().join(after, keys, "left_anti").agg(F.count("*").alias("lost"))


@query("update_verification", """
    select e.id, e.email, coalesce(s.k, e.smtp_status) as smtp_status from emails e
    left join (select email, case when refused then 'blocked' when code in (250, 251, 252) then 'deliverable' when code between 500 and 599 then 'rejected' else 'unknown' end as k from smtp) s on s.email = e.email""")
def update_verification(t):
    s = t.smtp.select("email", email.smtp_class(F.col("code"), F.col("refused")).alias("k"))
    return t.emails.join(s, "email", "left").select("id", "email", F.coalesce("k", "smtp_status").alias("smtp_status"))


@query("update_worker_verify", "select id, email, case when id % 2 = 0 then 'deliverable' else verdict end as verdict from emails")
def update_worker_verify(t):
    facts = t.emails.where("id % 2 = 0").select("id", F.lit("deliverable").alias("v"))
    return t.emails.select("id", "email", "verdict").join(facts, "id", "left").select("id", "email", F.coalesce("v", "verdict").alias("verdict"))


# suppression

SLUG = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+')"


def rule(c, e):
    want = f"list_filter({TOKENS.format(f'{e}.name')}, lambda w: length(w) >= 2)"
    have = TOKENS.format(f"{c}.name")
    return f"""({SLUG.format(f'{c}.name')} <> '' and {SLUG.format(f'{e}.name')} <> '' and ({SLUG.format(f'{c}.name')} = {SLUG.format(f'{e}.name')}
      or (len({want}) > 0 and len(list_filter({want}, lambda w: not list_contains({have}, w))) = 0)
      or (len({want}) = 1 and length({want}[1]) >= 4 and len(list_filter({have}, lambda w: starts_with(w, {want}[1]))) > 0)
      or coalesce({SLUG.format(f'{e}.domain')} <> '' and {SLUG.format(f'{c}.domain')} = {SLUG.format(f'{e}.domain')}, false)))"""


@query("blocklist_match", f"select c.id as company_id, e.id as entry_id from companies c, blocklist e where {rule('c', 'e')}")
def blocklist_match(t):
    return b.matches(t.companies, t.blocklist)


@query("join_theta_blocklist", f"select c.id, c.name from companies c where exists (select 1 from blocklist e where {rule('c', 'e')})")
def join_theta_blocklist(t):
    hit = b.matches(t.companies, t.blocklist).select(F.col("company_id").alias("id"))
    return t.companies.join(hit, "id", "left_semi").select("id", "name")


@query("join_blocklist_explain", f"select e.name as entry, count(c.id) as n, min(c.id) as first from blocklist e left join (select * from companies where blocked) c on {rule('c', 'e')} group by e.name")
def join_blocklist_explain(t):
    hit = b.matches(t.companies.where("blocked"), t.blocklist).groupBy("entry_id").agg(F.count("*").alias("n"), F.min("company_id").alias("first"))
    return t.blocklist.join(hit, F.col("id") == F.col("entry_id"), "left").select(F.col("name").alias("entry"), F.coalesce("n", F.lit(0).cast("long")).alias("n"), "first")


@query("update_blocked_flag", f"select id, blocked as was, exists (select 1 from blocklist e where {rule('c', 'e')}) as blocked from companies c")
def update_blocked_flag(t):
    return b.flags(t.companies, t.blocklist)


@query("update_blocked_changes", f"select id, exists (select 1 from blocklist e where e.id % 5 <> 0 and {rule('c', 'e')}) as blocked from companies c")
def update_blocked_changes(t):
    """Flags kept up to date while entries come and go: half of them, then the rest, then a fifth goes."""
    kept = Suppression(t.spark, folder(t.spark, "suppression"), 16)
    kept.add_companies(t.companies)
    kept.add(t.blocklist.where("id % 2 = 0"))
    kept.add(t.blocklist)
    kept.remove(t.blocklist.where("id % 5 = 0"))
    return kept.flags(t.companies)


REMOVED = f"select id from companies c where exists (select 1 from blocklist e where e.id % 2 = 0 and {rule('c', 'e')}) and not exists (select 1 from blocklist e where e.id % 2 <> 0 and {rule('c', 'e')})"


@query("join_any_remaining", REMOVED)
def join_any_remaining(t):
    return b.remaining_after(t.companies, t.blocklist, F.col("id") % 2 == 0)


@query("delete_entry_cascade", f"select c.id, c.blocked and c.id not in ({REMOVED}) as blocked from companies c")
def delete_entry_cascade(t):
    gone = b.remaining_after(t.companies, t.blocklist, F.col("id") % 2 == 0).withColumn("_g", F.lit(True))
    return t.companies.join(gone, "id", "left").select("id", (F.col("blocked") & F.col("_g").isNull()).alias("blocked"))


@query("is_blocked_candidate", f"select c.page_id, exists (select 1 from blocklist e where {rule('c', 'e')}) as blocked from (select page_id, concat('Customer#', lpad(cast(page_id as varchar), 9, '0'), ' Ltd') as name, 'x.example.com' as domain from pages) c")
def is_blocked_candidate(t):
    c = t.pages.select(F.col("page_id").alias("id"), F.concat(F.lit("Customer#"), F.lpad(F.col("page_id").cast("string"), 9, "0"), F.lit(" Ltd")).alias("name"), F.lit("x.example.com").alias("domain"), F.lit(False).alias("blocked"))
    return b.flags(c, t.blocklist).select(F.col("id").alias("page_id"), "blocked")


# conventions and verification

MIXED = """select ord, user_id as company_id, case ord % 4 when 0 then concat('ann.lee', '@c', user_id, '.com') when 1 then concat('bo_ek', '@c', user_id, '.com') when 2 then concat('cleo-ito', '@c', user_id, '.org') else concat('sales.uk', '@c', user_id, '.com') end as email from (select event_id as ord, cast(user_id as {s}) as user_id from events) e"""


def convention_emails(t):
    return t.events.selectExpr("event_id as ord", "user_id as company_id", "event_id as id", "case event_id % 4 when 0 then concat('ann.lee@c', user_id, '.com') when 1 then concat('bo_ek@c', user_id, '.com') when 2 then concat('cleo-ito@c', user_id, '.org') else concat('sales.uk@c', user_id, '.com') end as email")


CONVENTION = "select event_id as ord, event_id as id, user_id as company_id, case event_id % 4 when 0 then concat('ann.lee@c', user_id, '.com') when 1 then concat('bo_ek@c', user_id, '.com') when 2 then concat('cleo-ito@c', user_id, '.org') else concat('sales.uk@c', user_id, '.com') end as email from events"
VOTE = f"""select company_id, p as pattern from (select company_id, p, row_number() over (partition by company_id order by count(*) desc, p_ord) as rn
    from (select company_id, case when email like 'ann.%' then 'first.last' when email like 'bo\\_%' escape '\\' then 'first_last' when email like 'cleo-%' then 'first-last' end as p, case when email like 'ann.%' then 0 when email like 'bo\\_%' escape '\\' then 1 else 2 end as p_ord from ({CONVENTION}) c) v where p is not null group by company_id, p, p_ord) w where rn = 1"""


@query("agg_pattern_vote", VOTE)
def agg_pattern_vote(t):
    return r.pattern_votes(convention_emails(t))


@query("email_derive", f"""
    with conv as ({CONVENTION}), vote as ({VOTE}), dom as (select company_id, d as domain from (select company_id, d, row_number() over (partition by company_id order by count(*) desc, min(id)) as rn from (select *, split_part(email, '@', 2) as d from conv) z group by company_id, d) y where rn = 1)
    select * from (select p.id, p.company_id, concat(case coalesce(pattern, 'first.last') {' '.join(f"when '{k}' then {v}" for k, v in patterns_sql('f', 'g').items())} end, '@', domain) as email, 'pattern-derived' as email_status
      from (select id, company_id, {FIRST} as f, {LAST} as g from people where email is null) p join dom on dom.company_id = p.company_id left join vote on vote.company_id = p.company_id) m
    where not exists (select 1 from conv c where c.company_id = m.company_id and c.email = m.email)""")
def email_derive(t):
    return r.derived(t.people, convention_emails(t))


@query("email_verify_on_save", f"""
    with v as (select email, case when m.domain is null then 'invalid' when k = 'deliverable' then case when probe = 'deliverable' then 'catchall' else 'deliverable' end when k in ('rejected', 'blocked') then k else 'mx-ok' end as verdict
        from (select email, case event % 6 when 0 then 'deliverable' when 1 then 'deliverable' when 2 then 'rejected' else 'unknown' end as k, split_part(email, '@', 2) as d from (select email, min(id) as event from people where email is not null group by email) y) x
        left join (select distinct domain from mx) m on m.domain = d left join catchall c on c.domain = d)
    select p.id, case when p.email is null or verdict in ('rejected', 'invalid') then null else p.email end as email,
      case when p.email is null or verdict in ('rejected', 'invalid') then 'none-verified' when verdict = 'deliverable' then 'verified' when verdict = 'catchall' then 'catchall' else email_status end as email_status
    from people p left join v on v.email = p.email""")
def email_verify_on_save(t):
    first = t.people.where("email is not null").groupBy("email").agg(F.min("id").alias("e"))
    smtp = first.select("email", F.expr("case e % 6 when 0 then 'deliverable' when 1 then 'deliverable' when 2 then 'rejected' else 'unknown' end").alias("k"))
    m = t.mx.select(F.col("domain").alias("d")).distinct().withColumn("m", F.lit(True))
    c = t.catchall.select(F.col("domain").alias("d"), "probe")
    f = smtp.withColumn("d", email.domain(F.col("email"))).join(m, "d", "left").join(c, "d", "left")
    facts = f.select("email", email.verdict(F.col("email"), F.col("m").isNotNull(), F.col("k"), email.catchall_class(F.col("probe"), F.col("m").isNotNull())).alias("verdict"))
    none = t.spark.createDataFrame([], "id long, pos int, email string")
    return r.verified_people(t.people.select("id", "email", "email_status"), facts, none)


# discovery


@query("crawl_frontier", f"""
    select site, url, score from (select *, row_number() over (partition by site order by score, url) as rn from (select distinct site, url,
      case {' '.join(f"when {PAGE_WORD.format(w='|'.join(w)).replace('href', 'url')} then {k}" for k, w in LINKS)} else 9 end::int as score
      from (select site, concat('https://', h, rtrim(href, '/'), '/') as url from (select lower(regexp_extract(url, '://([^/?#]*)', 1)) as h, regexp_replace(regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', ''), '^m\\.', '') as site, unnest(['/about/', '/x/team', '/news', '/careers/jobs', '/shop/a']) as href from pages) a) b) c) d where rn <= 4""")
def crawl_frontier(t):
    host = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))
    links = t.pages.select(F.concat(F.lit("https://"), host, F.lit("/")).alias("base"), F.explode(F.array(*map(F.lit, ("/about/", "/x/team", "/news#top", "/careers/jobs", "/shop/a", "https://other.example.com/team/")))).alias("href"))
    return frontier(links, 4)


@query("join_setdefault_union", """
    select company_id, lname, source from (select *, row_number() over (partition by company_id, lname order by p) as rn from (select distinct company_id, lower(name) as lname, 'knowledge' as source, 0 as p from people where id % 3 = 0 union all select distinct company_id, lower(name), 'search', 1 from people) x) y where rn = 1""")
def join_setdefault_union(t):
    rows = lambda df, s, p: df.select("company_id", F.lower("name").alias("lname"), F.lit(s).alias("source"), F.lit(p).alias("p"))
    both = rows(t.people.where("id % 3 = 0"), "knowledge", 0).unionByName(rows(t.people, "search", 1))
    return both.groupBy("company_id", "lname").agg(F.min_by("source", "p").alias("source"))


@query("join_bio_links", """
    select p.id, coalesce(p.linkedin_url, l.link) as link from (select id, company_id, name, case when linkedin_type = 'profile' then linkedin_url end as linkedin_url from people) p
    left join (select company_id, lower(name) as k, max(concat('https://www.linkedin.com/in/', cast(id as varchar))) as link from people where id % 5 = 0 group by all) l on l.company_id = p.company_id and l.k = lower(p.name)""")
def join_bio_links(t):
    bios = t.people.where("id % 5 = 0").groupBy("company_id", F.lower("name").alias("k")).agg(F.max(F.concat(F.lit("https://www.linkedin.com/in/"), F.col("id").cast("string"))).alias("link"))
    p = t.people.select("id", "company_id", F.lower("name").alias("k"), F.when(F.col("linkedin_type") == "profile", F.col("linkedin_url")).alias("own"))
    return p.join(bios, ["company_id", "k"], "left").select("id", F.coalesce("own", "link").alias("link"))


@query("snippet_relevance_guard", "select page_id, contains(lower(title), 'the') or contains(lower(title), 'que') as ok from (select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages) x")
def snippet_relevance_guard(t):
    brand = F.filter(text.alnum_tokens(F.lit("The Que co")), lambda w: F.length(w) >= 3)
    return t.pages.select("page_id", F.exists(brand, lambda w: F.lower(text.html_title(F.col("html"))).contains(w)).alias("ok"))


@query("pipeline_clear_legacy", f"select id, name from blocklist where lower(name) not in ({quoted(['customer#000000007', 'customer#000000014'])})")
def pipeline_clear_legacy(t):
    legacy = t.spark.createDataFrame([("customer#000000007",), ("customer#000000014",)], "k string")
    return t.blocklist.withColumn("k", F.lower("name")).join(F.broadcast(legacy), "k", "left_anti").select("id", "name")
