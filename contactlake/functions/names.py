"""Personal names and titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let
from .values import HONORIFICS, NAME_STOP, NAME_TOKEN, STRONG_TITLE_WORDS, TITLE_BLOCKLIST, TITLE_WORDS

STOP = sorted({*NAME_STOP})


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def initials(name: Column) -> Column:
    return F.array_join(F.transform(F.slice(words(name), 1, 2), lambda x: F.upper(F.substring(x, 1, 1))), "")


def is_stop(name: Column, stop: list[str] | None = None) -> Column:
    """Under three letters, or any token on the stop list (a parameter)."""
    return (F.length(F.trim(name)) < 3) | F.arrays_overlap(words(F.lower(name)), F.array(*map(F.lit, stop or STOP)))


def looks_like(name: Column, stop: list[str] | None = None) -> Column:
    t = words(name)
    return F.coalesce(F.length(name).between(4, 40) & F.size(t).between(2, 4) & ~is_stop(name, stop) & F.forall(t, lambda x: x.rlike(f"^{NAME_TOKEN}$")), F.lit(False))


def company_words(company: Column, marks: str = "-") -> Column:
    return F.filter(words(F.lower(F.translate(company, marks, " " * len(marks)))), lambda x: F.length(x) >= 3)


def is_company(name: Column, company: Column, marks: str = "-") -> Column:
    return F.arrays_overlap(words(F.lower(name)), company_words(company, marks))


def adjacent_dup(t: Column) -> Column:
    """Whether two neighbours are equal. t stands outside the lambda: within, Catalyst would make the array anew for each element."""
    after = F.slice(t, F.lit(2), F.greatest(F.size(t), F.lit(0)))
    return F.coalesce(F.exists(F.zip_with(t, after, lambda a, b: F.coalesce(a == b, F.lit(False))), lambda same: same), F.lit(False))


def is_noise(name: Column, title: Column, email: Column, company: Column, stop: list[str] | None = None) -> Column:
    """Rejected as a person: stop words, odd characters, wrong length, titles in the name, repeats, the company itself, or nothing else known."""
    t = words(F.lower(name))
    low_title = F.lower(F.coalesce(title, F.lit("")))
    return (
        is_stop(name, stop)
        | ~name.rlike(r"^[\p{L}.'’\- ]+$")
        | ~F.size(t).between(2, 4)
        | F.arrays_overlap(t, F.array(*map(F.lit, TITLE_WORDS)))
        | adjacent_dup(t)
        | ((F.size(t) == 4) & (F.get(t, F.lit(0)) == F.get(t, F.lit(2))) & (F.get(t, F.lit(1)) == F.get(t, F.lit(3))))
        | (F.lower(name) == F.lower(company))
        | ((low_title == "") & F.coalesce(email, F.lit("")).eqNullSafe(""))
        | F.exists(F.array(*map(F.lit, TITLE_BLOCKLIST)), lambda b: low_title.contains(b))
        | is_company(name, company)
    )


def clean_title(title: Column) -> Column:
    out = F.btrim(F.trim(title), F.lit(", "))
    out = F.regexp_replace(out, r"(?i)\s*(?:read more|learn more|biography|details|website|profile|follow|more|view|bio)\s*$", "")
    return F.regexp_replace(F.btrim(out, F.lit(" ,–—-")), r"(?i)^(?:the|he|she|an|a|and|&|of)\s+", "")


LETTER = "A-Za-zÀ-ÖØ-öø-ÿĀ-ɏ"
WORD = rf"[{LETTER}][{LETTER}.'’\-]*"
ENDS = " ,–—-"


def _one_of(w: Column, listed) -> Column:
    return F.lower(w).isin(*sorted(listed))


def split_role(text: Column) -> Column:
    """(name, role) of `Ann Lee Founder and CEO`: split at the first title word, which must leave two to four words of a name before it; else null."""

    def split(w: Column) -> Column:
        at = F.get(F.filter(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.coalesce(_one_of(F.get(w, i), TITLE_WORDS), F.lit(False))), F.lit(0))
        return F.when((F.size(w) >= 3) & at.between(2, 4), F.array_join(F.slice(w, 1, at), " "))

    def named(name: Column) -> Column:
        rest = F.ltrim(F.trim(F.substr(text, F.length(name) + 1)), F.lit("–—,;: "))
        role = F.regexp_replace(F.regexp_replace(rest, r"(?U)\b[A-Za-z]\b\s*", ""), r"\s+", " ")
        return F.struct(name.alias("name"), F.btrim(role, F.lit(ENDS)).alias("role"))

    found = let(let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), split), named)
    return F.when(found["name"].isNotNull() & (F.length(found["role"]) >= 3), found)


def split_reversed(text: Column, company: Column | None = None) -> Column:
    """(name, role) of `Vice President, Fleet Brad Taylor`: the first name of two, else three words, with a leadership title before it; else null."""
    own = company_words(F.coalesce(company, F.lit("")), "&-") if company is not None else F.array().cast("array<string>")

    def of(size: int, w: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(w) - size, F.lit(1)))
        role = lambda at: F.filter(F.slice(w, F.lit(1), at), lambda x: ~_one_of(x, HONORIFICS) & ~F.array_contains(own, F.lower(x)))
        pairs = F.transform(places, lambda at: F.struct(F.array_join(F.slice(w, at + 1, F.lit(size)), " ").alias("name"), role(at).alias("words"), at.alias("at")))
        good = lambda p: (p["at"] + size <= F.size(w)) & looks_like(p["name"]) & F.exists(p["words"], lambda x: _one_of(x, STRONG_TITLE_WORDS))
        told = F.transform(F.filter(pairs, good), lambda p: F.struct(p["name"].alias("name"), F.btrim(F.array_join(p["words"], " "), F.lit(ENDS)).alias("role")))
        return F.filter(told, lambda p: F.length(p["role"]) >= 3)

    found = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.when(F.size(w) >= 4, F.get(F.concat(of(2, w), of(3, w)), F.lit(0))))
    return found
