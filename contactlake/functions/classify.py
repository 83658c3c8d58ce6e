"""Relevance of sites, blocklist matching, junk detection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import alnum_tokens, let, slug
from .values import JUNK_MARKERS, NEGATIVE, POSITIVE, TITLE_STRONG


def hits(text: Column, words) -> Column:
    """Those of the words that the text contains, in the list's order."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: text.contains(w))


def verdict(title: Column, meta: Column, body: Column, positive=POSITIVE, negative=NEGATIVE, strong=TITLE_STRONG) -> Column:
    """(ok, why) of a home page: a negative word decides, then positive ones, then strong words in the title.

    The page is cut and lowered once; a list is only gone through where the ones before it don't decide.
    """
    first = lambda h: F.array_join(F.slice(h, 1, 3), ", ")
    told = lambda ok, why: F.struct(F.lit(ok).alias("ok"), why.alias("why"))

    def by_title(head: Column) -> Column:
        return F.when(F.size(head) > 0, told(True, F.concat(F.lit("title signal: "), first(head)))).otherwise(told(False, F.lit("no signal on homepage")))

    def of(page: Column) -> Column:
        blob, low = page["blob"], page["low"]
        positives = let(hits(blob, positive), lambda yes: F.when(F.size(yes) > 0, told(True, F.concat(F.lit("signals: "), first(yes)))).otherwise(let(hits(low, strong), by_title)))
        return let(hits(blob, negative), lambda no: F.when(F.size(no) > 0, told(False, F.concat(F.lit("negative signal: "), F.get(no, F.lit(0))))).otherwise(positives))

    cut = F.substring(F.lower(F.substring(body, 1, 4000)), 1, 4000)
    page = F.struct(F.concat_ws(" ", F.lower(title), F.lower(meta), cut).alias("blob"), F.lower(title).alias("low"))
    return let(page, of)


def relevance(title: Column, meta: Column, body: Column, **lists) -> tuple[Column, Column]:
    """(relevant, reason) by verdict()."""
    told = verdict(title, meta, body, **lists)
    return told["ok"], told["why"]


def junk_markers(titles: Column) -> Column:
    return F.size(hits(F.lower(titles), JUNK_MARKERS))


def matches_entry(name: Column, domain: Column, entry: Column, entry_domain: Column) -> Column:
    """A blocklist entry fits: equal slugs, all its words among the company's, a long single word as a prefix, or equal domain slugs."""
    a, b = slug(name), slug(entry)
    have, want = alnum_tokens(name), F.filter(alnum_tokens(entry), lambda x: F.length(x) >= 2)
    whole = (F.size(want) > 0) & (F.size(F.array_except(want, have)) == 0)
    only = F.get(want, F.lit(0))
    prefix = (F.size(want) == 1) & (F.length(only) >= 4) & F.exists(have, lambda x: x.startswith(only))
    site = F.coalesce((slug(entry_domain) != "") & (slug(domain) == slug(entry_domain)), F.lit(False))
    return F.coalesce((a != "") & (b != "") & ((a == b) | whole | prefix | site), F.lit(False))
