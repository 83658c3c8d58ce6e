"""Urls, domains, search-result links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import BLOCKED_DOMAINS, COUNTRIES, LINK_WORDS, PEOPLE_PAGE, PRESS_PAGE, SOCIAL_EXCLUDED, SOCIAL_PATTERNS, TITLE_COUNT, TITLE_HEAD, TITLE_TAIL

EDGE = r"(?:^|[^\p{L}\p{N}_])"
EDGE_AFTER = r"(?:$|[^\p{L}\p{N}_])"


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def url_domain(url: Column) -> Column:
    """Lower-cased authority without www. and then m. in front."""
    return F.regexp_replace(F.regexp_replace(F.lower(authority(url)), r"^www\.", ""), r"^m\.", "")


def suffixes(domain: Column) -> Column:
    """A domain and its parents down to two labels."""
    labels = F.split(domain, r"\.")
    return F.when(F.size(labels) >= 2, F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def blocked(domain: Column, block: list[str] | None = None) -> Column:
    """No dot, or the domain or a parent is on the list."""
    return ~domain.contains(".") | F.coalesce(F.exists(suffixes(domain), lambda s: s.isin(*(block or BLOCKED_DOMAINS))), F.lit(False))


def strip_query(url: Column) -> Column:
    return F.split_part(url, F.lit("?"), F.lit(1))


def strip_fragment(url: Column) -> Column:
    return F.split_part(url, F.lit("#"), F.lit(1))


def joined(base: Column, href: Column) -> Column:
    """href seen from base if it stays on base's site; no fragment, slash at the end. Null elsewhere."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    whole = F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([^:]*:)", 1), href)).when(href.startswith("/"), F.concat(root, href))
    bare = F.rtrim(strip_fragment(whole), F.lit("/"))
    return F.when(F.lower(authority(whole)) == F.lower(authority(base)), F.concat(bare, F.lit("/")))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def has_word(c: Column, words: list[str]) -> Column:
    return c.rlike(f"(?i){EDGE}(?:{'|'.join(words)}){EDGE_AFTER}")


def people_page(url: Column) -> Column:
    return has_word(path(url), PEOPLE_PAGE)


def press_page(url: Column) -> Column:
    return has_word(path(url), PRESS_PAGE)


def link_priority(link_path: Column) -> Column:
    out = F.lit(9)
    for rank, words in reversed(LINK_WORDS):
        out = F.when(has_word(link_path, words), rank).otherwise(out)
    return out


def social_network(href: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(SOCIAL_PATTERNS):
        out = F.when(href.rlike(pattern), name).otherwise(out)
    return F.when(~href.rlike("(?i)" + "|".join(SOCIAL_EXCLUDED)), out)


def decode_target(href: Column) -> Column:
    """The percent-encoded uddg parameter."""
    return F.try_url_decode(F.nullif(F.regexp_extract(href, r"[?&]uddg=([^&#]*)", 1), F.lit("")))


def decode_tracked(href: Column) -> Column:
    """The base64url target of a tracked link; null unless it is a web address."""
    raw = F.regexp_extract(href, r"/ck/a.*[?&]u=a1([A-Za-z0-9_\-]+)", 1)
    url = F.unbase64(F.translate(raw, "-_", "+/")).cast("string")
    return F.when(url.startswith("http"), url)


def people_search(name: Column) -> Column:
    return F.concat(F.lit("https://www.linkedin.com/search/results/people/?keywords="), F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")))


def guesses(name: Column) -> Column:
    from .text import slug

    return F.transform(F.array(*map(F.lit, (".com", ".io", ".co", ".net", ".ai"))), lambda x: F.concat(slug(name), x))


def prettified(domain: Column) -> Column:
    return F.initcap(F.translate(F.split_part(domain, F.lit("."), F.lit(1)), "-_", "  "))


def company_from_title(title: Column, domain: Column) -> Column:
    cut = title
    for mark in (" - ", " | ", " – "):
        cut = F.split_part(cut, F.lit(mark), F.lit(1))
    cut = F.trim(cut)
    return F.when(F.length(cut).between(3, 60) & cut.contains(" "), cut).otherwise(prettified(domain))


def name_from_title(title: Column) -> Column:
    """A candidate company name: list and review wording dropped; null unless 3 to 60 characters."""
    out = F.regexp_replace(F.trim(title), TITLE_TAIL, "")
    out = F.regexp_replace(out, TITLE_HEAD, "")
    out = F.btrim(F.regexp_replace(out, TITLE_COUNT, ""), F.lit(" -–|"))
    return F.when((F.length(F.trim(title)) >= 4) & F.length(out).between(3, 60), out)


def _country(which: int, country: Column, default: str | None) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(x) for name, told in COUNTRIES.items() for x in (name, told[which])]), F.lower(country))
    return F.coalesce(found, F.lit(default)) if default else found


def country_code(country: Column, default: str = "ZZ") -> Column:
    return _country(0, country, default)


def country_item(country: Column) -> Column:
    return _country(1, country, None)
