"""E-mail addresses: extraction, validity, category, conventions, verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import accent_fold
from .values import DISPOSABLE, EMAIL_CATEGORIES, ROLE_LOCALS, TLDS, TWO_LABEL

EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PATTERNS = ("first.last", "first_last", "first-last", "firstinitial.last", "firstinitiallast", "firstlastinitial", "first", "last", "last.first")


def found_in(text: Column) -> Column:
    """Addresses in a text, lower-cased, in order."""
    return F.when(text.contains("@"), F.transform(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), F.lower)).otherwise(F.array().cast("array<string>"))


def mailto(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(r'(?i)href="mailto:([^"?]*)'), F.lit(1)), lambda x: F.lower(F.trim(x)))


def local(email: Column) -> Column:
    return F.split_part(email, F.lit("@"), F.lit(1))


def domain(email: Column) -> Column:
    return F.split_part(email, F.lit("@"), F.lit(-1))


def valid(email: Column) -> Column:
    """One @, plain characters, no double or edge dots, and a known ending; some countries need a known two-label one."""
    labels = F.split(domain(email), r"\.")
    n = F.size(labels)
    last = F.lower(F.element_at(labels, -1))
    two = F.concat_ws(".", F.lower(F.get(labels, n - 2)), last)
    ending = F.when(last.isin(*TWO_LABEL) & (n > 2), two).otherwise(last)
    shape = email.rlike(r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]([A-Za-z0-9.\-]*[A-Za-z0-9\-])?\z") & ~email.contains("..") & ~email.startswith(".")
    return F.coalesce(shape & (n >= 2) & ending.isin(*TLDS), F.lit(False))


def category(email: Column) -> Column:
    who, out = F.lower(local(email)), F.lit("General")
    for name, parts in reversed(EMAIL_CATEGORIES):
        out = F.when(who.rlike("|".join(parts)), name).otherwise(out)
    return out


def well_formed(email: Column) -> Column:
    return F.coalesce(email.rlike(rf"^{EMAIL}\z") & (F.length(email) - F.length(F.replace(email, F.lit("@"))) == 1), F.lit(False))


def disposable(email: Column) -> Column:
    return F.coalesce(domain(email).isin(*DISPOSABLE), F.lit(False))


def smtp_class(code: Column, refused: Column) -> Column:
    """refused: the server didn't take the sender."""
    return F.when(refused, "blocked").when(code.isin(250, 251, 252), "deliverable").when(code.between(500, 599), "rejected").otherwise("unknown")


def catchall_class(probe: Column, has_mx: Column) -> Column:
    return F.when(~has_mx, "unknown").when(probe == "deliverable", "yes").when(probe == "rejected", "no").otherwise("unknown")


def verdict(email: Column, has_mx: Column, smtp: Column, catchall: Column) -> Column:
    """The first that holds: malformed, throwaway, no mail server; then what the server said."""
    answered = F.when(smtp == "deliverable", F.when(catchall == "yes", "catchall").otherwise("deliverable")).when(smtp.isin("rejected", "blocked"), smtp).otherwise("mx-ok")
    return F.when(~well_formed(email), "invalid").when(disposable(email), "disposable").when(~has_mx, "invalid").otherwise(answered)


def verdict_rank(v: Column) -> Column:
    return F.when(v == "deliverable", 0).when(v == "catchall", 1).when(v == "mx-ok", 2).otherwise(9)


def name_parts(name: Column) -> Column:
    """Folded lower-case tokens of two letters or more."""
    return F.filter(F.split(F.lower(accent_fold(name)), r"[^\p{L}]+"), lambda x: F.length(x) >= 2)


def by_pattern(pattern: str, first: Column, last: Column) -> Column:
    f, l = F.substring(first, 1, 1), F.substring(last, 1, 1)
    return {
        "first.last": F.concat(first, F.lit("."), last),
        "first_last": F.concat(first, F.lit("_"), last),
        "first-last": F.concat(first, F.lit("-"), last),
        "firstinitial.last": F.concat(f, F.lit("."), last),
        "firstinitiallast": F.concat(f, last),
        "firstlastinitial": F.concat(first, l),
        "first": first,
        "last": last,
        "last.first": F.concat(last, F.lit("."), first),
    }[pattern]


def applied(pattern: Column, first: Column, last: Column) -> Column:
    out = F.lit(None).cast("string")
    for p in reversed(PATTERNS):
        out = F.when(pattern == p, by_pattern(p, first, last)).otherwise(out)
    return out


def inferred_from_pair(first: Column, last: Column, email: Column) -> Column:
    """The first convention that gives the address's local part (up to a plus sign)."""
    who, out = F.split_part(local(email), F.lit("+"), F.lit(1)), F.lit(None).cast("string")
    for p in reversed(PATTERNS):
        out = F.when(who == by_pattern(p, first, last), p).otherwise(out)
    return F.when((F.length(first) >= 2) & (F.length(last) >= 2), out)


def inferred_from_local(email: Column) -> Column:
    """The convention a bare address shows: two words of two letters or more, neither of them a role, and the mark between them."""
    who = F.lower(local(email))
    words = F.regexp_extract_all(who, F.lit("[a-z]{2,}"), F.lit(0))
    mark = F.when(who.contains("."), "first.last").when(who.contains("_"), "first_last").when(who.contains("-"), "first-last")
    return F.when((F.size(words) == 2) & ~F.arrays_overlap(words, F.array(*map(F.lit, ROLE_LOCALS))), mark)


def candidates(name: Column, at: Column) -> Column:
    """Eleven likely addresses of a person at a domain, likeliest first."""
    t = name_parts(name)
    first, last = F.get(t, F.lit(0)), F.element_at(t, -1)
    f, l = F.substring(first, 1, 1), F.substring(last, 1, 1)
    dot, bar, dash = F.lit("."), F.lit("_"), F.lit("-")
    forms = [F.concat(first, dot, last), F.concat(first, l), F.concat(f, last), F.concat(f, dot, last), F.concat(first, bar, last), F.concat(first, dash, last), first, F.concat(f, l), F.concat(last, dot, first), F.concat(first, dot, l), F.concat(f, dot, l)]
    return F.when(F.size(t) >= 2, F.transform(F.array_distinct(F.array(*forms)), lambda x: F.concat(x, F.lit("@"), at))).otherwise(F.array().cast("array<string>"))


def saved_status(enabled: Column, email: Column, verdict: Column, status: Column, winner: Column) -> Column:
    """A person's e-mail status after verification. Verdicts that settle nothing leave it; a bad or missing address gives
    way to the verdict of the best candidate, or none-verified."""
    lost = email.isNull() | verdict.isin("rejected", "invalid", "disposable")
    instead = F.when(winner == "deliverable", "verified").when(winner.isNotNull(), winner).otherwise("none-verified")
    return F.when(~enabled, F.coalesce(F.nullif(status, F.lit("")), F.lit("unverified"))).when(lost, instead).when(verdict == "deliverable", "verified").when(verdict == "catchall", "catchall").otherwise(status)
