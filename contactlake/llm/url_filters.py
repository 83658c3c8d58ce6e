"""URL filters: host and path rules, and block decisions shared along redirects and canonical links. DataFrames only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, stored
from .graph import connected_components


@dataclass(frozen=True)
class Rule:
    """verdict for host and its subdomains, where the url's path starts with path."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without one, and for null."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(host: Column, path: Column, rule: Rule) -> Column:
    return (F.concat(F.lit("."), host).endswith("." + rule.host)) & path.startswith(rule.path)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(rule name, verdict) of the longest rule that fits; of equally long ones allow wins, then the first by name."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "allow", [-ord(c) for c in r.name])):
        name = F.when(fits(host, path, r), F.lit(r.name)).otherwise(name)
        verdict = F.when(fits(host, path, r), F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def url_node(url: Column) -> Column:
    """What makes two urls the same page: host, path and query; scheme, its default port and fragment don't count. Null without a host."""
    host = url_host(url)
    scheme = lower_ascii(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    host = F.when((scheme == "http") & host.endswith(":80"), F.regexp_replace(host, ":80$", "")).when((scheme == "https") & host.endswith(":443"), F.regexp_replace(host, ":443$", "")).otherwise(host)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(rest == "", F.lit("/")).otherwise(rest)))


def _without_dots(path: Column) -> Column:
    """A path that starts with `/`, its `.` and `..` segments followed."""
    none = F.array().cast("array<string>")
    up = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
    step = lambda a, x: F.when(x == ".", a).when(x == "..", up(a)).otherwise(F.concat(a, F.array(x)))
    at = F.aggregate(F.split(F.substr(path, F.lit(2)), "/"), none, step)
    # a last dot segment names a directory
    done = F.concat(F.lit("/"), F.array_join(at, "/"), F.when(path.rlike(r"/\.\.?$") & (F.size(at) > 0), "/").otherwise(""))
    return F.when(path.rlike(r"/\.\.?(/|$)"), done).otherwise(path)


def _resolved(base: Column, target: Column) -> Column:
    """target as an absolute url, seen from base; null if it has another scheme without `//`, such as `mailto:`."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    own = url_path(base)
    own = F.when(own == "", "/").otherwise(own)
    path, query = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(\?[^#]*)", 1)
    site = F.concat(scheme, F.lit("://"), url_host(base))
    return (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("#"), base)
        .when(path == "", F.concat(site, own, query))
        .when(path.startswith("/"), F.concat(site, _without_dots(path), query))
        .otherwise(F.concat(site, _without_dots(F.concat(F.regexp_extract(own, r"(?s)^(.*/)", 1), path)), query))
    )


#: Tags that tell aliases, and what hides such tags from a browser, passed over in the same scan: comments and scripts, to
#: the end of the page if they aren't closed.
SEEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<(?:link|meta|base)\b[^>]*>"
BASE = r"""(?is)^<base\b[^>]*?\bhref\s*=\s*["']?\s*([^"'\s>]+)"""


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(u, v) between the nodes of pages and of their redirect and canonical-link targets.

    Targets come from `<link rel=canonical href=…>` and `<meta http-equiv=refresh content="…url=…">` anywhere in the
    html but in comments and scripts; attribute values may be quoted either way or bare. Relative ones are seen from the page's url, or from its
    first `<base href=…>`.
    """
    value = r"""\s*=\s*["']?\s*([^"'\s>]+)"""
    html = F.col("html")
    marked = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).where(F.col("url").isNotNull() & html.rlike(r"(?i)canonical|http-equiv\s*=\s*[\"']?\s*refresh"))
    seen = F.filter(F.regexp_extract_all("html", F.lit(SEEN), F.lit(0)), lambda t: t.rlike(r"(?i)^<(?:link|meta|base)"))
    marked = marked.select("url", seen.alias("tags"))
    told = F.get(F.filter(F.transform("tags", lambda t: F.regexp_replace(F.regexp_extract(t, BASE, 1), "&amp;", "&")), lambda x: x != ""), F.lit(0))
    tags = marked.select("url", told.alias("told"), F.explode("tags").alias("tag"))
    tag = F.col("tag")
    canonical = F.when(tag.rlike(r"(?i)\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"), F.regexp_extract(tag, r"(?i)\bhref" + value, 1))
    refresh = F.when(tag.rlike(r"(?i)\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"), F.regexp_extract(tag, r"(?i)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)", 1))
    target = F.regexp_replace(F.coalesce(canonical, refresh), "&amp;", "&")
    # each step is written, else the optimiser would paste a step's whole expression into the next, as often as it is named there
    links = stored(tags.select("url", "told", target.alias("target")), "links").where("target <> ''")
    if links.isEmpty():
        return pages.sparkSession.createDataFrame([], "u string, v string")
    links = stored(links.select("url", F.coalesce(_resolved(F.col("url"), F.col("told")), F.col("url")).alias("base"), "target"), "bases")
    links = stored(links.select("url", _resolved(F.col("base"), F.col("target")).alias("to")), "targets")
    nodes = stored(links.select(url_node(F.col("url")).alias("u"), url_node(F.col("to")).alias("v")), "nodes")
    return nodes.where("u <> v").distinct()


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages.

    A url's own rule decides. A url without one follows its aliases, the pages it reaches over redirects and
    canonical links in either direction: if the rule of any alias allows, it is allowed; else if the rule of any
    alias blocks, it is blocked; else allowed. Targets that are no pages count as aliases with rules of their own.
    redirects: further (from_url, to_url) edges, such as a crawler's log. A url that is null or has no `://` has an
    empty host and path, fits no rule, has no aliases and is allowed. A null html has no links. Repeated urls share
    their aliases. Of rules of equal length an allow wins. Other columns of pages are ignored. An empty table gives an
    empty result.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    edges = alias_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(url_node(F.col("from_url")).alias("u"), url_node(F.col("to_url")).alias("v")).where("u <> v")).distinct()
    comp = connected_components(edges)
    # the node's text is host and rest, so the rules can be applied to targets that are no pages
    at = F.concat(F.lit("x://"), F.col("node"))
    ruled = comp.select("component", rule_of(url_host(at), url_path(at), rules)[1].alias("v"))
    decided = ruled.groupBy("component").agg(F.when(F.max(F.col("v") == "allow"), "allow").when(F.max(F.col("v") == "block"), "block").alias("shared")).where("shared is not null")
    shared = comp.join(decided, "component").select("node", "shared")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = rows.withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url"))).withColumn("node", url_node(F.col("url")))
    # rows without a node are dealt over many keys that no node has
    apart = F.concat(F.lit(" "), F.pmod(F.xxhash64("page_id", "url"), F.lit(4096)).cast("string"))
    judged = judged.withColumn("rule", name).withColumn("own", verdict).withColumn("node", F.coalesce("node", apart)).join(shared, "node", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("own", "shared", F.lit("allow")).alias("verdict"))
