"""Queries of what a crawl visits and of what a search or a name leads to."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactlake.functions.values import GUESS_PATHS, LINK_WORDS
from contactlake.operators import frontier as f
from contactlake.sources.seed import DIRECTORY, seed_rows

from .registry import query


def literal(x) -> str:
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


@query("source_seed", f"""
    select name, domain, country, country_code, city, category, employees::int as employees, founded::int as founded, concat('https://www.', domain) as website,
           concat(name, ' — ', category, ' based in ', city, ', ', country, '.') as description, 'fleet,telematics' as tags
    from (values {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in DIRECTORY)}) v(name, domain, country, country_code, city, category, employees, founded)""")
def source_seed(t):
    return seed_rows(t.spark).select("name", "domain", "country", "country_code", "city", "category", "employees", "founded", "website", "description", "tags")


SITE_MAP = r"""
    select company_id, url, row_number() over (partition by company_id order by score, url) as rank from (
      select company_id, split_part(full_url, '#', 1) as url, case when regexp_matches(p, '(^|[^a-z0-9_])(leadership|executive|board|our-team|team|who-we-are)($|[^a-z0-9_])') then 0 when regexp_matches(p, '(^|[^a-z0-9_])about($|[^a-z0-9_])') then 1
          when regexp_matches(p, '(^|[^a-z0-9_])people($|[^a-z0-9_])') then 5 when regexp_matches(p, '(^|[^a-z0-9_])founder($|[^a-z0-9_])') then 9 end as score
      from (select company_id, full_url, lower(regexp_extract(full_url, '^https://[^/?#]*([^?#]*)', 1)) as p
            from (select company_id, case when loc like '/%' then concat(base, loc) else loc end as full_url from (select company_id, base, unnest(regexp_extract_all(xml, '<loc>\s*(.*?)\s*</loc>', 1)[1:500]) as loc from sitemaps) a) b) c
      where p not in ('', '/') and not regexp_matches(p, 'wp-content|wp-json|cart|checkout|tag/|category/|author/|\.xml')) d
    where score is not null qualify row_number() over (partition by company_id order by score, url) <= 6"""


@query("source_sitemap", SITE_MAP)
def source_sitemap(t):
    return f.sitemap_urls(t.sitemaps, "company_id")


GUESSED = f"""
    select company_id, concat(rtrim(concat('https://c', company_id, '.example.com', path), '/'), '/') as url, row_number() over (partition by company_id order by pos) as rank
    from fetches join (values {', '.join(f"('{p}', {i})" for i, p in enumerate(GUESS_PATHS))}) g(path, pos) using (path)
    where status < 400 and not contains(lower(title), 'not found') and not contains(title, '404') qualify row_number() over (partition by company_id order by pos) <= 3"""


@query("source_guess_paths", GUESSED)
def source_guess_paths(t):
    return f.guessed_pages(t.fetches, "company_id")


LINKED = f"""
    select company_id, url, row_number() over (partition by company_id order by score, url) as rank from (
      select *, case {' '.join(f"when regexp_matches(url, '^https://[^/]*/(?:.*[^a-z0-9_])?(?:{'|'.join(w)})[^a-z0-9_]') then {k}" for k, w in LINK_WORDS)} else 9 end as score
      from (select distinct company_id, concat(rtrim(split_part(case when href like 'https:%' then href else concat(rtrim(base, '/'), href) end, '#', 1), '/'), '/') as url from home_links where href not like 'https:%') a) b where score < 9"""


@query("source_page_discover", f"""
    with s as ({SITE_MAP}), g as ({GUESSED}), l as ({LINKED}),
      u as (select id as company_id, concat('https://', domain, '/') as url, 0 as stage, 1 as nth from companies union all select company_id, url, 1, rank from s union all select company_id, url, 2, rank from g union all select company_id, url, 3, rank from l),
      o as (select company_id, url, stage, nth from u qualify row_number() over (partition by company_id, url order by stage, nth) = 1)
    select company_id, url, row_number() over (partition by company_id order by stage, nth) as rank from o qualify row_number() over (partition by company_id order by stage, nth) <= 10""")
def source_page_discover(t):
    home = t.companies.select(F.col("id").alias("company_id"), F.concat(F.lit("https://"), "domain", F.lit("/")).alias("url"))
    return f.pages_to_visit(home, f.sitemap_urls(t.sitemaps, "company_id"), f.guessed_pages(t.fetches, "company_id"), f.linked_pages(t.home_links, "company_id"), "company_id")


@query("source_robots", """
    select company_id, url, case company_id % 5 when 0 then not starts_with(p, '/private/') when 1 then false when 2 then true when 3 then starts_with(p, '/about/') or not starts_with(p, '/news') else false end as allowed
    from (select company_id, concat(base, ltrim(href, '/')) as url, href as p from home_links where href not like 'https:%') u""")
def source_robots(t):
    urls = t.home_links.where("href not like 'https:%'").select("company_id", F.concat("base", F.ltrim("href", F.lit("/"))).alias("url"))
    return f.robots_allowed(urls.join(t.robots, "company_id"), "company_id", "LeadsBot/1.0")


WORDS2 = "list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda w: length(w) >= 2)"


@query("topk_wiki_pages", f"""
    select company_id, title, score, row_number() over (partition by company_id order by score desc, pos) as rank from (
      select company_id, pos, title, ((case when w[1] = own[1] then 5 else 0 end) + (case when lower(title) = lower(name) then 3 else 0 end)
          + (case when regexp_matches(lower(title), '\\(company\\)|\\binc\\b|\\bcorporation\\b|\\bltd\\b') then 4 else 0 end) + len(list_intersect(own, w)))::int as score
      from (select *, {WORDS2.format('name')} as own, {WORDS2.format('title')} as w from wiki_hits) a where len(w) > 0) b where score >= 5""")
def topk_wiki_pages(t):
    return f.wiki_titles(t.wiki_hits, "company_id")


@query("topk_domain_guess", """
    select company_id, domain, score from (select company_id, domain, pos, ((case when contains(lower(coalesce(title, '')), 'customer') or contains(lower(coalesce(title, '')), substr(name, 10)) then 2 else 0 end)
        + (case when domain like '%.com' then 1 when domain like '%.io' or domain like '%.ai' or domain like '%.org' then 0.5 else 0 end))::double as score from domain_probes) a
    qualify row_number() over (partition by company_id order by score desc, pos) = 1""")
def topk_domain_guess(t):
    return f.best_domain(t.domain_probes, "company_id")


@query("source_wikitext", """
    with recursive hop as (select page_id as title, page_id as final, 0::bigint as hops, [page_id] as seen from pages
      union all select title, target, hops + 1, list_append(seen, target) from hop join wiki_redirects on source = final where hops < 3 and not list_contains(seen, target))
    select title, arg_max(final, hops) as final, max(hops) as hops from hop group by title""")
def source_wikitext(t):
    return f.followed(t.pages.select(F.col("page_id").alias("title")), t.wiki_redirects)
