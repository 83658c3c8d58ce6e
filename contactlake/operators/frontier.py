"""Which pages of a site to visit, and which site or page a name means: candidates scored by their words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from urllib.robotparser import RobotFileParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlake.functions.text import alnum_tokens
from contactlake.functions.url import has_word, joined, link_priority, path, strip_fragment, url_domain
from contactlake.functions.values import GUESS_PATHS, SITEMAP_NOISE, SITEMAP_WORDS

from .keep import ranked


def soft_404(title: Column) -> Column:
    """A page that exists but says it doesn't."""
    low = F.lower(F.coalesce(title, F.lit("")))
    return low.contains("not found") | low.contains("404")


def sitemap_urls(sites: DataFrame, key: str, k: int = 6, most: int = 500) -> DataFrame:
    """(key, url, rank): the k best of a sitemap's first entries, by link words, then url. sites: (key, base, xml)."""
    locs = F.slice(F.regexp_extract_all("xml", F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), 1, most)
    rows = sites.select(key, "base", F.explode(locs).alias("loc"))
    rows = _once(rows, url=F.when(F.col("loc").startswith("/"), F.concat("base", "loc")).otherwise(F.col("loc")))
    rows, at = _once(rows, at=F.lower(path(F.col("url")))), F.col("at")
    noise = reduce(lambda a, b: a | b, [at.contains(x) for x in SITEMAP_NOISE])
    score = F.lit(None).cast("int")
    for rank, words in reversed(SITEMAP_WORDS):
        score = F.when(has_word(at, words), rank).otherwise(score)
    rows = _once(rows.where(~at.isin("", "/") & ~noise), score=score).where("score is not null").select(key, strip_fragment(F.col("url")).alias("url"), "score")
    return _numbered(rows, [key], [F.col("score"), F.col("url")], k).select(key, "url", "rank")


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns computed once a row: a plain projection is pasted into every later filter and branch that names it."""
    return reduce(lambda out, c: out.select("*", F.explode(F.array(c[1])).alias(c[0])), columns.items(), rows)


def _numbered(rows: DataFrame, keys: list, order: list, k: int) -> DataFrame:
    return ranked(rows, keys, order, k, keep="rank")


def guessed_pages(fetched: DataFrame, key: str, k: int = 3) -> DataFrame:
    """(key, url, rank): the first k of the usual paths that exist. fetched: (key, base, path, status, title)."""
    order = fetched.sparkSession.createDataFrame(list(enumerate(GUESS_PATHS)), "pos int, path string")
    ok = fetched.where((F.col("status") < 400) & ~soft_404(F.col("title"))).join(F.broadcast(order), "path")
    url = F.concat(F.rtrim(F.concat("base", "path"), F.lit("/")), F.lit("/"))
    return _numbered(ok.withColumn("url", url), [key], [F.col("pos")], k).select(key, "url", "rank")


def linked_pages(links: DataFrame, key: str) -> DataFrame:
    """(key, url, rank) of a home page's links to its own site that hold a link word, best first. links: (key, base, href)."""
    rows = _once(links.select(key, "base", "href"), url=joined(F.col("base"), F.col("href"))).where("url is not null").select(key, "url")
    rows = _once(_once(rows, at=F.lower(path(F.col("url")))), score=link_priority(F.col("at"))).where("score < 9").select(key, "url", "score").distinct()
    return _numbered(rows, [key], [F.col("score"), F.col("url")], 1 << 30).select(key, "url", "rank")


def pages_to_visit(home: DataFrame, sitemap: DataFrame, guessed: DataFrame, linked: DataFrame, key: str, k: int = 10) -> DataFrame:
    """(key, url, rank): the home page, then sitemap, guessed and linked pages, each url once, k in all. home: (key, url)."""
    parts = [home.withColumn("rank", F.lit(1)), sitemap, guessed, linked]
    rows = reduce(DataFrame.unionByName, [p.select(key, "url", F.struct(F.lit(i).alias("stage"), F.col("rank").cast("int").alias("at")).alias("place")) for i, p in enumerate(parts)])
    first = rows.groupBy(key, "url").agg(F.min("place").alias("place"))
    return _numbered(first, [key], [F.col("place")], k).select(key, "url", "rank")


def robots_allowed(urls: DataFrame, key: str, agent: str) -> DataFrame:
    """(key, url, allowed) under each site's robots file. urls: (key, url, status, body).

    401 and 403 forbid everything, any other failure, a null status among them, nothing; else the rules of the first group that names the agent, or
    of `*`, in their order: the first that fits decides.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, RobotFileParser] = {}
        for batch in it:
            allowed = []
            for url, body in zip(batch.column("url").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if body not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[body] = RobotFileParser()
                    known[body].parse(body.splitlines())
                allowed.append(known[body].can_fetch(agent, url))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("url"), pa.array(allowed, pa.bool_())], [key, "url", "allowed"])

    told = urls.where("status = 200").select(F.col(key).cast("long").alias(key), "url", F.coalesce("body", F.lit("")).alias("body")).mapInArrow(run, f"{key} long, url string, allowed boolean")
    other = urls.where("coalesce(status, 0) <> 200").select(F.col(key).cast("long").alias(key), "url", (~F.coalesce("status", F.lit(0)).isin(401, 403)).alias("allowed"))
    return told.unionByName(other)


def crawl_frontier(links: DataFrame, k: int) -> DataFrame:
    """(site, url, score) from links (base, href): same-site targets, each once, the k best by words and then url."""
    rows = links.select(url_domain(F.col("base")).alias("site"), joined(F.col("base"), F.col("href")).alias("url")).where("url is not null").distinct()
    rows = rows.withColumn("score", link_priority(path(F.col("url"))))
    return ranked(rows, ["site"], [F.col("score"), F.col("url")], k).select("site", "url", "score")


def wiki_titles(hits: DataFrame, key: str, least: int = 5) -> DataFrame:
    """(key, title, score, rank) of search hits (key, name, pos, title) that may be about the company, best first."""
    words = lambda c: F.filter(alnum_tokens(c), lambda w: F.length(w) >= 2)
    own, theirs = words(F.col("name")), words(F.col("title"))
    brand = F.coalesce(F.get(own, F.lit(0)), F.lower("name"))
    score = (
        F.when(F.get(theirs, F.lit(0)) == brand, 5).otherwise(0)
        + F.when(F.lower(F.trim("name")) == F.lower(F.trim("title")), 3).otherwise(0)
        + F.when(F.col("title").contains("(company)") | has_word(F.col("title"), ["inc", "corporation", "ltd"]), 4).otherwise(0)
        + F.size(F.array_intersect(own, theirs))
    )
    rows = hits.where(F.size(theirs) > 0).withColumn("score", score).where(F.col("score") >= least)
    return _numbered(rows, [key], [F.col("score").desc(), F.col("pos")], 1 << 30).select(key, "title", "score", "rank")


def best_domain(probes: DataFrame, key: str) -> DataFrame:
    """(key, domain, score): the best of the domains that answered, the first of equals. probes: (key, name, pos, domain, title)."""
    tokens = F.slice(F.filter(F.split("name", "[^A-Za-z0-9]+"), lambda w: F.length(w) >= 3), 1, 2)
    named = F.exists(tokens, lambda w: F.lower(F.coalesce("title", F.lit(""))).contains(F.lower(w)))
    score = F.when(named, 2.0).otherwise(0.0) + F.when(F.col("domain").endswith(".com"), 1.0).when(F.col("domain").rlike(r"\.(io|ai|org)$"), 0.5).otherwise(0.0)
    return probes.withColumn("score", score).groupBy(key).agg(F.max_by(F.struct("domain", "score"), F.struct(F.col("score"), -F.col("pos"))).alias("x")).select(key, "x.domain", "x.score")


def followed(start: DataFrame, redirects: DataFrame, hops: int = 3) -> DataFrame:
    """(title, final, hops): where a title's redirects lead, never to one already seen. start: (title); redirects: (source, target)."""
    at = start.select("title", F.col("title").alias("final"), F.lit(0).cast("long").alias("hops"), F.array("title").alias("seen"))
    for _ in range(hops):
        at = at.join(redirects, (F.col("final") == F.col("source")) & ~F.array_contains("seen", F.col("target")), "left")
        went = F.col("target").isNotNull()
        at = at.select("title", F.coalesce("target", "final").alias("final"), (F.col("hops") + went.cast("long")).alias("hops"), F.when(went, F.array_append("seen", F.col("target"))).otherwise(F.col("seen")).alias("seen"))
    return at.select("title", "final", "hops")
