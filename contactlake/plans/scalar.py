"""Queries of scalar functions over documents, pages, people and companies."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactlake.functions import classify, email, markup, names, phone, text, url
from contactlake.functions.values import BLOCKED_DOMAINS, DISPOSABLE, EMAIL_CATEGORIES, JUNK_MARKERS, LINK_WORDS, NEGATIVE, PEOPLE_PAGE, POSITIVE, PRESS_PAGE, ROLE_LOCALS, TITLE_BLOCKLIST, TITLE_STRONG, TITLE_WORDS, TLDS, TWO_LABEL
from contactlake.operators.frontier import soft_404
from contactlake.operators.pages import spread

from .registry import query


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


E = email.EMAIL
FOUND = f"select doc_id, unnest(list_transform(regexp_extract_all(text, '{E}'), lambda x: lower(x))) as email from documents"


def documents_emails(t):
    return t.documents.select("doc_id", F.explode(email.found_in(F.col("text"))).alias("email"))


@query("email_extract_text", FOUND)
def email_extract_text(t):
    return documents_emails(t)


MAIL_HTML = "concat('<a href=\"MAILTO: Sales.', cast(event_id as {s}), '@Acme.example.com?subject=x\">write</a> <a href=\"/x\">x</a> <a href=\"tel:+49 30 ', cast(100000 + event_id as {s}), '\">call</a><a href=\"tel:12\">no</a>')"


@query("email_extract_mailto", f"""
    select event_id, unnest(list_transform(regexp_extract_all(html, '(?i)href="mailto:([^"?]*)', 1), lambda x: lower(trim(x)))) as email from (select event_id, {MAIL_HTML.format(s='varchar')} as html from events) e""")
def email_extract_mailto(t):
    h = t.events.selectExpr("event_id", MAIL_HTML.format(s="string") + " as html")
    return h.select("event_id", F.explode(email.mailto(F.col("html"))).alias("email"))


@query("phone_extract_tel", f"""
    select event_id, unnest(list_filter(list_transform(regexp_extract_all(html, '(?i)href="tel:([^"]*)"', 1), lambda x: trim(x)), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) between 7 and 15)) as phone from (select event_id, {MAIL_HTML.format(s='varchar')} as html from events) e""")
def phone_extract_tel(t):
    h = t.events.selectExpr("event_id", MAIL_HTML.format(s="string") + " as html")
    return h.select("event_id", F.explode(phone.tel(F.col("html"))).alias("phone"))


ADDRESS = """case event_id % 12 when 0 then 'a@b.com' when 1 then 'a..b@c.com' when 2 then 'x@mail.acme.in' when 3 then 'x@a.co.in' when 4 then 'x@a.com.tr' when 5 then '.x@a.de'
    when 6 then 'a@b@c.com' when 7 then 'x@a.museum' when 8 then 'jane.doe@yopmail.com' when 9 then 'hr-team@a.fr' when 10 then 'x@-a.com.' else concat(event_type, '_', 'desk', '@shop', cast(event_id as {s}), '.io') end"""


def addresses(t):
    return t.events.selectExpr("event_id", ADDRESS.format(s="string") + " as email")


FROM_ADDRESSES = f"from (select event_id, {ADDRESS.format(s='varchar')} as email from events) a"


@query("email_valid", f"""
    select event_id, email, regexp_full_match(email, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9\\-]([A-Za-z0-9.\\-]*[A-Za-z0-9\\-])?') and not contains(email, '..') and not starts_with(email, '.') and len(l) >= 2
      and (case when l[-1] in ({quoted(TWO_LABEL)}) and len(l) > 2 then concat(l[-2], '.', l[-1]) else l[-1] end) in ({quoted(TLDS)}) as ok
    from (select event_id, email, string_split(lower(split_part(email, '@', -1)), '.') as l {FROM_ADDRESSES}) x""")
def email_valid(t):
    return addresses(t).select("event_id", "email", email.valid(F.col("email")).alias("ok"))


@query("email_category", f"select event_id, case {' '.join(f"when regexp_matches(lower(split_part(email, '@', 1)), '{'|'.join(w)}') then '{n}'" for n, w in EMAIL_CATEGORIES)} else 'General' end as category {FROM_ADDRESSES}")
def email_category(t):
    return addresses(t).select("event_id", email.category(F.col("email")).alias("category"))


@query("email_local_domain", f"select event_id, split_part(email, '@', 1) as local, split_part(email, '@', -1) as domain {FROM_ADDRESSES}")
def email_local_domain(t):
    return addresses(t).select("event_id", email.local(F.col("email")).alias("local"), email.domain(F.col("email")).alias("domain"))


@query("email_syntax", f"select event_id, regexp_full_match(email, '{E}') and length(email) - length(replace(email, '@', '')) = 1 as ok {FROM_ADDRESSES}")
def email_syntax(t):
    return addresses(t).select("event_id", email.well_formed(F.col("email")).alias("ok"))


@query("email_disposable", f"select event_id, split_part(email, '@', -1) in ({quoted(DISPOSABLE)}) as disposable {FROM_ADDRESSES}")
def email_disposable(t):
    return addresses(t).select("event_id", email.disposable(F.col("email")).alias("disposable"))


@query("smtp_code_class", "select email, code, case when refused then 'blocked' when code in (250, 251, 252) then 'deliverable' when code between 500 and 599 then 'rejected' else 'unknown' end as k from smtp")
def smtp_code_class(t):
    return t.smtp.select("email", "code", email.smtp_class(F.col("code"), F.col("refused")).alias("k"))


@query("email_catchall", "select c.domain, case when m.domain is null then 'unknown' when probe = 'deliverable' then 'yes' when probe = 'rejected' then 'no' else 'unknown' end as catchall from catchall c left join (select distinct domain from mx) m on m.domain = c.domain")
def email_catchall(t):
    m = t.mx.select("domain").distinct().withColumn("m", F.lit(True))
    return t.catchall.join(m, "domain", "left").select("domain", email.catchall_class(F.col("probe"), F.col("m").isNotNull()).alias("catchall"))


VERDICT = f"""
    select e.email, case when not (regexp_full_match(e.email, '{E}')) then 'invalid' when split_part(e.email, '@', -1) in ({quoted(DISPOSABLE)}) then 'disposable' when m.domain is null then 'invalid'
      when s.k = 'deliverable' then case when c.probe = 'deliverable' then 'catchall' else 'deliverable' end when s.k in ('rejected', 'blocked') then s.k else 'mx-ok' end as verdict
    from (select distinct email from found_emails union select 'x@yopmail.com' union select 'bad') e left join (select distinct domain from mx) m on m.domain = split_part(e.email, '@', -1)
    left join (select email, case when refused then 'blocked' when code in (250, 251, 252) then 'deliverable' when code between 500 and 599 then 'rejected' else 'unknown' end as k from smtp) s on s.email = e.email
    left join catchall c on c.domain = split_part(e.email, '@', -1)"""


def verified(t, rows):
    """email with has_mx, smtp, catchall and verdict, from the facts tables."""
    m = t.mx.select(F.col("domain").alias("_d")).distinct().withColumn("_m", F.lit(True))
    s = t.smtp.select("email", email.smtp_class(F.col("code"), F.col("refused")).alias("smtp"))
    c = t.catchall.select(F.col("domain").alias("_d"), "probe")
    out = rows.withColumn("_d", email.domain(F.col("email"))).join(m, "_d", "left").join(s, "email", "left").join(c, "_d", "left")
    out = out.withColumn("has_mx", F.col("_m").isNotNull()).withColumn("catchall", email.catchall_class(F.col("probe"), F.col("has_mx")))
    return out.withColumn("verdict", email.verdict(F.col("email"), F.col("has_mx"), F.col("smtp"), F.col("catchall"))).drop("_d", "_m", "probe")


@query("email_verdict", VERDICT)
def email_verdict(t):
    rows = t.found_emails.select("email").unionByName(t.spark.createDataFrame([("x@yopmail.com",), ("bad",)], "email string")).distinct()
    return verified(t, rows).select("email", "verdict")


@query("join_verify_lookup", """
    select e.id, e.email, m.domain is not null as has_mx, s.k as smtp, case when m.domain is null then 'unknown' when c.probe = 'deliverable' then 'yes' when c.probe = 'rejected' then 'no' else 'unknown' end as catchall
    from emails e left join (select distinct domain from mx) m on m.domain = split_part(e.email, '@', -1)
    left join (select email, case when refused then 'blocked' when code in (250, 251, 252) then 'deliverable' when code between 500 and 599 then 'rejected' else 'unknown' end as k from smtp) s on s.email = e.email
    left join catchall c on c.domain = split_part(e.email, '@', -1)""")
def join_verify_lookup(t):
    """What each address's lookups told: mail server, mailbox, catch-all."""
    return verified(t, t.emails.select("id", "email")).select("id", "email", "has_mx", "smtp", "catchall")


FIRST = "lower(strip_accents(split_part(name, ' ', 1)))"
LAST = "lower(strip_accents(split_part(name, ' ', 2)))"


@query("email_candidates", f"""
    select id, concat(l, '@', domain) as email from (select p.id, c.domain, unnest(['a.b']) as x, f, g, unnest(list_distinct([concat(f, '.', g), concat(f, g[1]), concat(f[1], g), concat(f[1], '.', g), concat(f, '_', g), concat(f, '-', g), f, concat(f[1], g[1]), concat(g, '.', f), concat(f, '.', g[1]), concat(f[1], '.', g[1])])) as l
    from (select id, company_id, {FIRST} as f, {LAST} as g from people) p join companies c on c.id = p.company_id) y""")
def email_candidates(t):
    c = t.companies.select(F.col("id").alias("company_id"), "domain")
    return t.people.select("id", "company_id", "name").join(c, "company_id").select("id", F.explode(email.candidates(F.col("name"), F.col("domain"))).alias("email"))


def patterns_sql(f, g):
    return {"first.last": f"concat({f}, '.', {g})", "first_last": f"concat({f}, '_', {g})", "first-last": f"concat({f}, '-', {g})", "firstinitial.last": f"concat({f}[1], '.', {g})", "firstinitiallast": f"concat({f}[1], {g})", "firstlastinitial": f"concat({f}, {g}[1])", "first": f, "last": g, "last.first": f"concat({g}, '.', {f})"}


PATTERN_OF = "case id % 9 " + " ".join(f"when {i} then '{p}'" for i, p in enumerate(email.PATTERNS)) + " end"


@query("email_pattern_apply", f"select id, p, case p {' '.join(f"when '{k}' then {v}" for k, v in patterns_sql('f', 'g').items())} end as local from (select id, {PATTERN_OF} as p, {FIRST} as f, {LAST} as g from people) x")
def email_pattern_apply(t):
    parts = email.name_parts(F.col("name"))
    return t.people.selectExpr("id", "name", f"{PATTERN_OF} as p").select("id", "p", email.applied(F.col("p"), F.get(parts, F.lit(0)), F.element_at(parts, -1)).alias("local"))


@query("email_pattern_infer_pair", f"select id, case {' '.join(f"when who = {v} then '{k}'" for k, v in patterns_sql('f', 'g').items())} end as pattern from (select id, case id % 3 when 0 then concat({FIRST}[1], '.', {LAST}) when 1 then {FIRST} else 'other' end as who, {FIRST} as f, {LAST} as g from people) x")
def email_pattern_infer_pair(t):
    parts = email.name_parts(F.col("name"))
    p = t.people.select("id", F.get(parts, F.lit(0)).alias("f"), F.element_at(parts, -1).alias("g"))
    mail = F.concat(F.when(F.col("id") % 3 == 0, F.concat(F.substring("f", 1, 1), F.lit("."), "g")).when(F.col("id") % 3 == 1, F.col("f")).otherwise("other"), F.lit("+tag@x.com"))
    return p.select("id", email.inferred_from_pair(F.col("f"), F.col("g"), mail).alias("pattern"))


LOCALS = f"""
    select {{k}}, case when len(w) = 2 and len(list_intersect(w, [{quoted(ROLE_LOCALS)}])) = 0 then case when contains(who, '.') then 'first.last' when contains(who, '_') then 'first_last' when contains(who, '-') then 'first-last' end end as pattern
    from (select {{k}}, lower(split_part(email, '@', 1)) as who, regexp_extract_all(lower(split_part(email, '@', 1)), '[a-z]{{{{2,}}}}') as w {{rest}}) x"""


@query("email_pattern_infer_local", LOCALS.format(k="event_id", rest=FROM_ADDRESSES).replace("{{2,}}", "{2,}"))
def email_pattern_infer_local(t):
    return addresses(t).select("event_id", email.inferred_from_local(F.col("email")).alias("pattern"))


@query("name_email_pair", r"""
    select event_id, regexp_extract(line, '([A-Z][a-z]+(?: [A-Z][a-z]+){1,3}) ?[,(:] ?([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})', 1) as name, regexp_extract(line, '([A-Z][a-z]+(?: [A-Z][a-z]+){1,3}) ?[,(:] ?([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})', 2) as email
    from (select event_id, concat('write to ', case event_id % 3 when 0 then 'Ann Lee, ' when 1 then 'Bob van Dyk (' else 'Cleo Novak: ' end, event_type, '@acme.example.com today') as line from events) x""")
def name_email_pair(t):
    from contactlake.functions.people import name_email

    lines = t.events.selectExpr("event_id", "concat('write to ', case event_id % 3 when 0 then 'Ann Lee, ' when 1 then 'Bob van Dyk (' else 'Cleo Novak: ' end, event_type, '@acme.example.com today') as line")
    return lines.select("event_id", *name_email(F.col("line")))


# phones


@query("phone_extract_intl", r"select doc_id, unnest(list_filter(regexp_extract_all(text, '\+[0-9][0-9 \t\n\f\r\-().]{6,18}[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) between 7 and 15)) as phone from documents")
def phone_extract_intl(t):
    return t.documents.select("doc_id", F.explode(phone.intl_found_in(F.col("text"))).alias("phone"))


@query("phone_extract_us", r"select doc_id, unnest(regexp_extract_all(text, '\([0-9]{3}\)[ \t\n\f\r.\-]?[0-9]{3}[ \t\n\f\r.\-]?[0-9]{4}')) as phone from documents")
def phone_extract_us(t):
    return t.documents.select("doc_id", F.explode(phone.us_found_in(F.col("text"))).alias("phone"))


@query("phone_digits", "select ord, regexp_replace(phone, '[^0-9]', '', 'g') as digits, length(regexp_replace(phone, '[^0-9]', '', 'g'))::bigint as n from found_phones")
def phone_digits(t):
    d = F.regexp_replace("phone", "[^0-9]", "")
    return t.found_phones.select("ord", d.alias("digits"), F.length(d).cast("long").alias("n"))


# urls

HREF = """case event_id % 10 when 0 then 'https://www.linkedin.com/company/acme' when 1 then 'https://x.com/acme' when 2 then 'https://www.x.com/acme#top' when 3 then 'https://facebook.com/sharer?u=1'
    when 4 then 'https://facebook.com/acme' when 5 then 'https://twitter.com/acme/status/1' when 6 then 'https://youtube.com/@a' when 7 then '/about' when 8 then '//cdn.acme.example.com/team/' else concat('https://acme.example.com/our-team/', event_type, '?x=1#y') end"""


def hrefs(t):
    return t.events.selectExpr("event_id", HREF + " as href")


FROM_HREFS = f"from (select event_id, {HREF} as href from events) h"


@query("social_classify", f"""
    select event_id, case when regexp_matches(href, '(?i)share|sharer|intent|hashtag|login|oauth|dialog|embed|feed|status') then null when regexp_matches(href, 'linkedin\\.com/company/') then 'linkedin' when regexp_matches(href, 'linkedin\\.com/school/') then 'linkedin'
      when regexp_matches(href, '(?:^|\\.)x\\.com/') then 'x' when regexp_matches(href, 'twitter\\.com/') then 'twitter' when regexp_matches(href, 'facebook\\.com/') then 'facebook' when regexp_matches(href, 'instagram\\.com/') then 'instagram' when regexp_matches(href, 'youtube\\.com/') then 'youtube' end as network,
      split_part(href, '#', 1) as url {FROM_HREFS}""")
def social_classify(t):
    return hrefs(t).select("event_id", url.social_network(F.col("href")).alias("network"), url.strip_fragment(F.col("href")).alias("url"))


DOMAIN = "regexp_replace(regexp_replace(lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)), '^www\\.', ''), '^m\\.', '')"


@query("url_domain", f"select page_id, {DOMAIN.format(u='url')} as domain from pages")
def url_domain(t):
    return t.pages.select("page_id", url.url_domain(F.col("url")).alias("domain"))


SUFFIX = "not contains(d, '.') or len(list_filter(range(1, len(string_split(d, '.'))), lambda i: array_to_string(string_split(d, '.')[i:], '.') in ({block}))) > 0"


@query("url_blocked", f"select event_id, {SUFFIX.format(block=quoted(BLOCKED_DOMAINS))} as blocked from (select event_id, {DOMAIN.format(u='href')} as d {FROM_HREFS}) x")
def url_blocked(t):
    return hrefs(t).select("event_id", url.blocked(url.url_domain(F.col("href"))).alias("blocked"))


@query("join_domain_suffix", f"""
    with d as (select distinct {DOMAIN.format(u='url')} as d from pages) select d as domain from d where len(list_filter(range(1, len(string_split(d, '.'))), lambda i: array_to_string(string_split(d, '.')[i:], '.') in ('example.net', 'ththth.example.org', 'com'))) > 0""")
def join_domain_suffix(t):
    block = t.spark.createDataFrame([("example.net",), ("ththth.example.org",), ("com",)], "suffix string")
    d = t.pages.select(url.url_domain(F.col("url")).alias("domain")).distinct()
    return d.select("domain", F.explode(url.suffixes(F.col("domain"))).alias("suffix")).join(F.broadcast(block), "suffix", "left_semi").select("domain").distinct()


@query("url_strip_query", f"select event_id, split_part(href, '?', 1) as bare {FROM_HREFS}")
def url_strip_query(t):
    return hrefs(t).select("event_id", url.strip_query(F.col("href")).alias("bare"))


@query("url_strip_fragment", f"select event_id, split_part(href, '#', 1) as bare {FROM_HREFS}")
def url_strip_fragment(t):
    return hrefs(t).select("event_id", url.strip_fragment(F.col("href")).alias("bare"))


@query("url_join", f"""
    select event_id, case when lower(regexp_extract(w, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)) = 'acme.example.com' then concat(rtrim(split_part(w, '#', 1), '/'), '/') end as url
    from (select event_id, case when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\\-]*://') then href when starts_with(href, '//') then concat('https:', href) when starts_with(href, '/') then concat('https://acme.example.com', href) end as w {FROM_HREFS}) x""")
def url_join(t):
    return hrefs(t).select("event_id", url.joined(F.lit("https://acme.example.com/en/"), F.col("href")).alias("url"))


PAGE_WORD = "regexp_matches(regexp_extract(href, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1), '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:{w})(?:$|[^\\p{{L}}\\p{{N}}_])')"


@query("url_path_class_people", f"select event_id, {PAGE_WORD.format(w='|'.join(PEOPLE_PAGE))} as people {FROM_HREFS}")
def url_path_class_people(t):
    return hrefs(t).select("event_id", url.people_page(F.col("href")).alias("people"))


@query("url_path_class_press", f"select event_id, {PAGE_WORD.format(w='|'.join(PRESS_PAGE))} as press {FROM_HREFS}")
def url_path_class_press(t):
    return hrefs(t).select("event_id", url.press_page(F.col("href")).alias("press"))


KEYWORDS = ("team", "company", "about", "our-team")


@query("keyword_boundary_match", " union all ".join(f"select event_id, '{k}' as kw {FROM_HREFS} where regexp_matches(href, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_]){k}(?:$|[^\\p{{L}}\\p{{N}}_])')" for k in KEYWORDS))
def keyword_boundary_match(t):
    # each pattern is a constant, compiled once
    hits = F.array(*[F.when(url.has_word(F.col("href"), [k]), F.lit(k)) for k in KEYWORDS])
    return hrefs(t).select("event_id", F.explode(F.array_compact(hits)).alias("kw"))


@query("url_decode_ddg", "select page_id, url as target from pages")
def url_decode_ddg(t):
    h = F.concat(F.lit("//search.example.com/l/?uddg="), F.url_encode("url"), F.lit("&rut=1"))
    return t.pages.select("page_id", url.decode_target(h).alias("target"))


@query("url_decode_bing", "select page_id, url as target from pages")
def url_decode_bing(t):
    h = F.concat(F.lit("https://search.example.com/ck/a?!&&p=1&u=a1"), F.rtrim(F.translate(F.regexp_replace(F.base64(F.col("url").cast("binary")), r"\s", ""), "+/", "-_"), F.lit("=")), F.lit("&ntb=1"))
    return t.pages.select("page_id", url.decode_tracked(h).alias("target"))


@query("url_search_link", "select id, concat('https://www.linkedin.com/search/results/people/?keywords=', url_encode(name)) as link from people")
def url_search_link(t):
    return t.people.select("id", url.people_search(F.col("name")).alias("link"))


@query("domain_guess", "select id, unnest(list_transform(['.com', '.io', '.co', '.net', '.ai'], lambda x: concat(regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), x))) as guess from companies")
def domain_guess(t):
    return t.companies.select("id", F.explode(url.guesses(F.col("name"))).alias("guess"))


PRETTY = "array_to_string(list_transform(string_split(translate(split_part({d}, '.', 1), '-_', '  '), ' '), lambda w: concat(upper(w[1]), lower(w[2:]))), ' ')"


@query("domain_prettify", f"select event_id, {PRETTY.format(d='d')} as name from (select event_id, concat('my-', event_type, '_shop', '.example.com') as d from events) x")
def domain_prettify(t):
    return t.events.select("event_id", url.prettified(F.concat(F.lit("my-"), "event_type", F.lit("_shop.example.com"))).alias("name"))


TITLES = "case event_id % 5 when 0 then 'Acme Fleet - GPS | Home' when 1 then 'Acme' when 2 then 'Top 10 Trackers - directory of firms' when 3 then '7 Best Apps | Review 2020' else concat('Firm ', event_type, ' – list of all') end"


@query("company_name_from_title", f"""
    select event_id, case when length(c) between 3 and 60 and contains(c, ' ') then c else 'My Acme' end as name
    from (select event_id, trim(split_part(split_part(split_part(title, ' - ', 1), ' | ', 1), ' – ', 1)) as c from (select event_id, {TITLES} as title from events) y) x""")
def company_name_from_title(t):
    return t.events.selectExpr("event_id", TITLES + " as title").select("event_id", url.company_from_title(F.col("title"), F.lit("my-acme.io")).alias("name"))


@query("title_name_candidate", rf"""
    select event_id, case when length(c) between 3 and 60 then c end as name from (select event_id, trim(regexp_replace(regexp_replace(regexp_replace(title, '(?i)\s*[-–|]\s*(?:source|review|top|best|compare|list|directory).*$', ''), '(?i)^top\s+[0-9]+\s+', ''), '(?i)^[0-9]+\s+(?:top|best)\s+', ''), ' -–|') as c
    from (select event_id, {TITLES} as title from events) y) x""")
def title_name_candidate(t):
    return t.events.selectExpr("event_id", TITLES + " as title").select("event_id", url.name_from_title(F.col("title")).alias("name"))


COUNTRY = "case n_nationkey % 5 when 0 then 'Germany' when 1 then 'UK' when 2 then 'Saudi Arabia' when 3 then 'Atlantis' else 'czechia' end"


@query("country_code", f"select n_nationkey, case {COUNTRY} when 'Germany' then 'DE' when 'UK' then 'GB' when 'Saudi Arabia' then 'SA' when 'czechia' then 'CZ' else 'ZZ' end as code from nation")
def country_code(t):
    return t.nation.selectExpr("n_nationkey", COUNTRY + " as c").select("n_nationkey", url.country_code(F.col("c")).alias("code"))


@query("country_qid", f"select n_nationkey, case {COUNTRY} when 'Germany' then 'Q183' when 'UK' then 'Q145' when 'Saudi Arabia' then 'Q851' when 'czechia' then 'Q213' end as item from nation")
def country_qid(t):
    return t.nation.selectExpr("n_nationkey", COUNTRY + " as c").select("n_nationkey", url.country_item(F.col("c")).alias("item"))


# names

NAMES = "case event_id % 9 when 0 then 'Anna López' when 1 then 'Web Team' when 2 then 'Chief Officer' when 3 then 'Ann Ann Lee' when 4 then 'Ann Lee Ann Lee' when 5 then 'jo' when 6 then 'Acme Smith' when 7 then 'Ann Lee' else concat('Bo ', upper(substr(event_type, 1, 1)), substr(event_type, 2)) end"
STOP = f"(length(name) < 3 or len(list_intersect(string_split(lower(name), ' '), [{quoted(names.STOP)}])) > 0)"
FROM_NAMES = f"from (select event_id, {NAMES} as name, case when event_id % 2 = 0 then 'CEO' when event_id % 7 = 0 then 'Head of Fire Department' else null end as title, case when event_id % 4 = 1 then 'a@b.com' end as email from events) n"


def people_names(t):
    return t.events.selectExpr("event_id", NAMES + " as name", "case when event_id % 2 = 0 then 'CEO' when event_id % 7 = 0 then 'Head of Fire Department' else null end as title", "case when event_id % 4 = 1 then 'a@b.com' end as email")


@query("name_is_stop", f"select event_id, {STOP} as stop {FROM_NAMES}")
def name_is_stop(t):
    return people_names(t).select("event_id", names.is_stop(F.col("name")).alias("stop"))


@query("name_looks_like", f"select event_id, length(name) between 4 and 40 and len(string_split(name, ' ')) between 2 and 4 and not {STOP} and len(list_filter(string_split(name, ' '), lambda w: not regexp_matches(w, '^[A-ZÀ-ÖØ-Þ]'))) = 0 as ok {FROM_NAMES}")
def name_looks_like(t):
    return people_names(t).select("event_id", names.looks_like(F.col("name")).alias("ok"))


@query("name_is_company", f"select event_id, len(list_intersect(string_split(lower(name), ' '), ['acme', 'tracking'])) > 0 as ok {FROM_NAMES}")
def name_is_company(t):
    return people_names(t).select("event_id", names.is_company(F.col("name"), F.lit("Acme-Tracking co")).alias("ok"))


@query("name_company_word", f"select event_id, len(list_intersect(string_split(lower(name), ' '), ['acme', 'lee'])) > 0 as ok {FROM_NAMES}")
def name_company_word(t):
    return people_names(t).select("event_id", names.is_company(F.col("name"), F.lit("Acme&Lee co"), "-&").alias("ok"))


T = "string_split(lower(name), ' ')"


@query("person_noise_filter", f"""
    select event_id, name from (select *, {T} as w, lower(coalesce(title, '')) as lt {FROM_NAMES}) x where not ({STOP} or len(w) not between 2 and 4 or len(list_intersect(w, [{quoted(TITLE_WORDS)}])) > 0
      or len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) > 0 or (len(w) = 4 and w[1] = w[3] and w[2] = w[4]) or lower(name) = 'acme tracking' or (lt = '' and email is null)
      or len(list_filter([{quoted(TITLE_BLOCKLIST)}], lambda b: contains(lt, b))) > 0 or len(list_intersect(w, ['acme', 'tracking'])) > 0)""")
def person_noise_filter(t):
    return people_names(t).where(~names.is_noise(F.col("name"), F.col("title"), F.col("email"), F.lit("Acme Tracking"))).select("event_id", "name")


@query("title_clean", """
    select event_id, case event_id % 4 when 0 then 'Head of Data' when 1 then 'Director' when 2 then 'Sales Manager' else 'CEO' end as title from events""")
def title_clean(t):
    raw = F.expr("case event_id % 4 when 0 then ' The Head of Data, Read More ' when 1 then 'Director – bio' when 2 then ', Sales Manager view' else 'CEO' end")
    return t.events.select("event_id", names.clean_title(raw).alias("title"))


@query("accent_fold", "select id, strip_accents(name) as plain from people")
def accent_fold(t):
    return t.people.select("id", text.accent_fold(F.col("name")).alias("plain"))


# html, json, markup

TEXT = r"""trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\n\x0B\f\r]+', ' ', 'g'))"""


@query("html_text", f"select page_id, {TEXT} as txt from pages")
def html_text(t):
    return t.pages.select("page_id", text.html_text(F.col("html")).alias("txt"))


@query("html_title", "select page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \\t\\n]+', ' ', 'g')) as title from pages")
def html_title(t):
    return t.pages.select("page_id", text.html_title(F.col("html")).alias("title"))


@query("html_links", """select page_id, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref="([^"]*)"', 1)) as href from pages""")
def html_links(t):
    return t.pages.select("page_id", F.explode(text.html_links(F.col("html"))).alias("href"))


@query("html_meta", """select event_id, event_type as content from events""")
def html_meta(t):
    h = F.concat(F.lit('<head><META charset="x"><meta name="description" content="'), "event_type", F.lit('"><meta name="keywords" content="k">'))
    return t.events.select("event_id", text.html_meta(h, "description").alias("content"))


@query("html_soft404", "select page_id, contains(lower(title), 'not found') or contains(title, '404') as soft from (select page_id, case page_id % 4 when 0 then 'Page Not Found' when 1 then concat('Error 404', page_id) else regexp_extract(html, '<title>([^<]*)</title>', 1) end as title from pages) x")
def html_soft404(t):
    title = F.when(F.col("page_id") % 4 == 0, "Page Not Found").when(F.col("page_id") % 4 == 1, F.concat(F.lit("Error 404"), F.col("page_id").cast("string"))).otherwise(text.html_title(F.col("html")))
    return t.pages.select("page_id", soft_404(title).alias("soft"))


@query("json_address", "select event_id, concat_ws(', ', concat(cast(event_id as varchar), ' Rd'), event_type, case when event_id % 3 = 0 then 'DE' end) as address from events")
def json_address(t):
    j = F.to_json(F.struct(F.concat(F.col("event_id").cast("string"), F.lit(" Rd")).alias("streetAddress"), F.col("event_type").alias("addressLocality"), F.lit("").alias("addressRegion"), F.when(F.col("event_id") % 3 == 0, "DE").alias("addressCountry")))
    parts = [F.get_json_object(j, f"$.{k}") for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")]
    return t.events.select("event_id", text.joined_address(*parts).alias("address"))


@query("json_payload_parse", "select id, cast(json_extract_string(payload, '$.k') as bigint) as k, json_valid(payload) as ok from worker_log")
def json_payload_parse(t):
    return t.worker_log.select("id", F.get_json_object("payload", "$.k").cast("long").alias("k"), F.try_parse_json("payload").isNotNull().alias("ok"))


@query("json_build", """select event_id, concat('{"job":"', event_type, '","n":', cast(user_id as varchar), '}') as payload from events""")
def json_build(t):
    return t.events.select("event_id", F.to_json(F.struct(F.col("event_type").alias("job"), F.col("user_id").alias("n"))).alias("payload"))


WIKI = "concat('{{Infobox}}\\n| founder = [[Ann Lee|Ann B. Lee]] <ref name=x>y</ref> [[', event_type, ']]<br/>x\\n| key_people = {{ubl|Bo Ek|([[CEO]])}}\\n')"


@query("markup_wiki_clean", "select event_id, concat('founder = Ann B. Lee ', event_type, ', x') as line from events")
def markup_wiki_clean(t):
    return t.events.selectExpr("event_id", WIKI + " as w").select("event_id", markup.clean(F.regexp_extract("w", r"\| (founder[^\n]*)", 1)).alias("line"))


@query("markup_infobox_prep", "select event_id, 'Bo Ek|(CEO)' as people from events")
def markup_infobox_prep(t):
    return t.events.selectExpr("event_id", WIKI + " as w").select("event_id", markup.field(markup.prepared(F.col("w")), "key_people").alias("people"))


@query("markup_infobox_field", "select event_id, concat('[[Ann Lee|Ann B. Lee]] <ref name=x>y</ref> [[', event_type, ']]<br/>x') as founder from events")
def markup_infobox_field(t):
    return t.events.selectExpr("event_id", WIKI + " as w").select("event_id", markup.field(F.col("w"), "founder").alias("founder"))


@query("markup_clean_name", "select event_id, case event_id % 3 when 0 then 'Ann Lee' when 1 then 'Bo Ek' end as name from events")
def markup_clean_name(t):
    raw = F.expr("case event_id % 3 when 0 then '[[Ann Lee]] (born 1970), ' when 1 then ' Bo Ek et al.' else 'abc' end")
    return t.events.select("event_id", markup.clean_name(raw).alias("name"))


@query("markup_clean_role", "select event_id, case when event_id % 2 = 0 then 'CEO' end as role from events")
def markup_clean_role(t):
    return t.events.select("event_id", markup.clean_role(F.when(F.col("event_id") % 2 == 0, "([[CEO]],)").otherwise(" ()")).alias("role"))


# classification


@query("classify_relevance", f"""
    select doc_id, case when len(n) > 0 then false else len(p) > 0 or len(h) > 0 end as ok, case when len(n) > 0 then concat('negative signal: ', n[1]) when len(p) > 0 then concat('signals: ', array_to_string(p[1:3], ', ')) when len(h) > 0 then concat('title signal: ', array_to_string(h[1:3], ', ')) else 'no signal on homepage' end as reason
    from (select doc_id, list_filter([{quoted(NEGATIVE)}], lambda w: contains(blob, w)) as n, list_filter([{quoted(POSITIVE)}], lambda w: contains(blob, w)) as p, list_filter([{quoted(TITLE_STRONG)}], lambda w: contains(ti, w)) as h
      from (select doc_id, lower(ti) as ti, concat_ws(' ', lower(ti), '', substr(lower(text), 1, 4000)) as blob from (select doc_id, text, case doc_id % 4 when 0 then 'Fleet Vehicle Home' when 1 then 'Online dictionary' else 'Welcome' end as ti from documents) z) y) x""")
def classify_relevance(t):
    title = F.expr("case doc_id % 4 when 0 then 'Fleet Vehicle Home' when 1 then 'Online dictionary' else 'Welcome' end")
    return spread(t.documents.select("doc_id", "text")).select("doc_id", classify.verdict(title, F.lit(""), F.col("text")).alias("v")).select("doc_id", "v.ok", F.col("v.why").alias("reason"))


@query("detect_junk_serp", f"""
    select query_ord, count(*) >= 3 and sum(case when m then 1 else 0 end) >= 0 and len(list_filter([{quoted(JUNK_MARKERS)}], lambda w: contains(lower(string_agg(title, ' | ')), w))) >= 2 as junk
    from (select query_ord, case when query_ord = 1 then concat(title, ' Definition & Meaning – Cambridge Dictionary') else title end as title, true as m from search_results) x group by query_ord""")
def detect_junk_serp(t):
    r = t.search_results.withColumn("title", F.when(F.col("query_ord") == 1, F.concat("title", F.lit(" Definition & Meaning – Cambridge Dictionary"))).otherwise(F.col("title")))
    # each title is searched on its own: markers are joined, not the titles
    marks = [F.max(F.lower("title").contains(m)).cast("int") for m in JUNK_MARKERS]
    return r.groupBy("query_ord").agg(((F.count("*") >= 3) & (sum(marks, F.lit(0)) >= 2)).alias("junk"))


@query("slug_normalize", "select id, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') as slug from companies")
def slug_normalize(t):
    return t.companies.select("id", text.slug(F.col("name")).alias("slug"))


@query("tokenize_alnum", "select page_id, array_to_string(regexp_extract_all(lower(url), '[a-z0-9]+'), ' ') as tokens from pages")
def tokenize_alnum(t):
    return t.pages.select("page_id", F.array_join(text.alnum_tokens(F.col("url")), " ").alias("tokens"))


# small primitives


@query("ts_format_iso", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as at from events")
def ts_format_iso(t):
    return t.events.select("event_id", text.iso_time(F.col("ts")).alias("at"))


@query("ts_parse_mixed", "select event_id, epoch(date_trunc('second', ts))::bigint as at from events")
def ts_parse_mixed(t):
    raw = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(text.iso_time(F.col("ts")))
    return t.events.select("event_id", F.unix_seconds(text.parsed_time(raw)).alias("at"))


@query("ts_now_utc")
def ts_now_utc(t):
    return t.region.select("r_regionkey", F.current_timestamp().alias("now"))


@query("math_ceil_div", "select event_id, (user_id + 23) // 24 as pages from events")
def math_ceil_div(t):
    return t.events.select("event_id", F.floor((F.col("user_id") + 23) / 24).cast("long").alias("pages"))


@query("math_mod", "select event_id, user_id % 7 as k from events")
def math_mod(t):
    return t.events.select("event_id", F.pmod("user_id", F.lit(7)).alias("k"))


@query("math_round", "select event_type, round(sum(cast(value * 100 as bigint)) / count(*) / 100.0, 1)::double as mean from events group by event_type")
def math_round(t):
    return t.events.groupBy("event_type").agg(F.round(F.sum((F.col("value") * 100).cast("long")) / F.count("*") / 100.0, 1).alias("mean"))


@query("math_ratio_pct", "select event_type, case when count(*) = 0 then 0.0 else round(100.0 * count(*) filter (user_id % 2 = 0) / count(*), 1) end::double as pct from events group by event_type")
def math_ratio_pct(t):
    return t.events.groupBy("event_type").agg(F.when(F.count("*") == 0, 0.0).otherwise(F.round(100.0 * F.count_if(F.col("user_id") % 2 == 0) / F.count("*"), 1)).alias("pct"))


@query("math_bool_sum", "select event_type, count(*) filter (value > 50) as n from events group by event_type")
def math_bool_sum(t):
    return t.events.groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("n"))


WORDS = "string_split(text, ' ')"


@query("array_slice", f"select doc_id, array_to_string({WORDS}[1:6], ' ') as head from documents")
def array_slice(t):
    return t.documents.select("doc_id", F.array_join(F.slice(F.split("text", " "), 1, 6), " ").alias("head"))


@query("array_first_match", f"select doc_id, list_filter({WORDS}, lambda w: length(w) > 9)[1] as word from documents")
def array_first_match(t):
    return t.documents.select("doc_id", F.get(F.filter(F.split("text", " "), lambda w: F.length(w) > 9), F.lit(0)).alias("word"))


@query("array_adjacent_dup", f"select doc_id, len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) > 0 as dup from (select doc_id, {WORDS} as w from documents) x")
def array_adjacent_dup(t):
    return t.documents.select("doc_id", names.adjacent_dup(F.split("text", " ")).alias("dup"))


@query("map_setdefault", "select user_id, event_type, min(event_id) as first from events group by all")
def map_setdefault(t):
    return t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))


@query("map_count", "select user_id, event_type, count(*) as n from events group by all")
def map_count(t):
    return t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("str_trim_chars", "select event_id, trim(concat(' ,–', event_type, '—- '), ' ,–—-') as s from events")
def str_trim_chars(t):
    return t.events.select("event_id", text.trim_chars(F.concat(F.lit(" ,–"), "event_type", F.lit("—- ")), " ,–—-").alias("s"))


@query("str_truncate", "select doc_id, substr(text, 1, 70) as s from documents")
def str_truncate(t):
    return t.documents.select("doc_id", F.substring("text", 1, 70).alias("s"))


@query("str_squeeze_ws", "select doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) as s from documents")
def str_squeeze_ws(t):
    return t.documents.select("doc_id", text.squeezed(F.col("text")).alias("s"))


@query("proxy_spec_parse", "select user_id, case when user_id % 2 = 0 then concat('a', cast(user_id as varchar), '|b') else '' end as pool from (select distinct user_id from events) e")
def proxy_spec_parse(t):
    spec = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("pool: a"), F.col("user_id").cast("string"), F.lit(", b,"))).otherwise("direct")
    parts = F.filter(F.transform(F.split(F.regexp_extract(spec, "^pool:(.*)", 1), ","), lambda x: F.trim(x)), lambda x: x != "")
    return t.events.select("user_id").distinct().select("user_id", F.array_join(parts, "|").alias("pool"))


LINKS = LINK_WORDS  # the frontier's words, for its oracle
