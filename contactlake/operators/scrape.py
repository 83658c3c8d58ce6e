"""From what pages told about companies to facts worth keeping."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from contactlake.functions import email, names, url

from .keep import digits, keep_first, ranked

#: Fixed: the people that one scrape of a company keeps at most.
MOST_PEOPLE = 60


def clean_people(found: DataFrame, companies: DataFrame, most: int = MOST_PEOPLE) -> DataFrame:
    """found people (company_id, name, title, email, …, ord) without noise, each name once per company, the first `most` of each."""
    own = companies.select(F.col("id").alias("company_id"), F.col("name").alias("_company"))
    rows = found.join(own, "company_id").withColumn("name", F.trim("name")).withColumn("title", names.clean_title(F.coalesce("title", F.lit(""))))
    rows = rows.where(~names.is_noise(F.col("name"), F.col("title"), F.col("email"), F.col("_company")))
    first = keep_first(rows.withColumn("_k", F.lower("name")), ["company_id", "_k"])
    return ranked(first, ["company_id"], [F.col("ord")], most).drop("_k", "_company")


def with_fallback(people: DataFrame, todo: DataFrame, open_sources: DataFrame) -> DataFrame:
    """people, and for companies of todo (company_id) that have none those of open_sources (company_id, name, title, ord), each name once."""
    bare = todo.join(people.select("company_id"), "company_id", "left_anti")
    more = keep_first(open_sources.join(bare, "company_id").withColumn("_k", F.lower("name")), ["company_id", "_k"]).drop("_k")
    return people.unionByName(more, allowMissingColumns=True)


def distinct_phones(found: DataFrame) -> DataFrame:
    return keep_first(found.withColumn("_k", digits(F.col("phone"))).where("_k <> ''"), ["company_id", "_k"]).drop("_k")


def distinct_socials(found: DataFrame) -> DataFrame:
    return keep_first(found.withColumn("_k", url.strip_query(F.col("url"))), ["company_id", "network", "_k"]).drop("_k")


def saved_people(people: DataFrame) -> DataFrame:
    """As they are stored: an address that didn't verify goes with its status, a missing link becomes a people search."""
    bad = F.coalesce(F.col("email_status").isin("none-verified", "rejected", "invalid"), F.lit(False))
    drop = lambda c: F.when(~bad, F.col(c))
    out = people.withColumn("email", drop("email")).withColumn("email_status", drop("email_status"))
    link = F.coalesce(F.nullif("linkedin_url", F.lit("")), url.people_search(F.col("name")))
    return out.withColumn("linkedin_type", F.when(F.coalesce("linkedin_url", F.lit("")) == "", "search").otherwise(F.col("linkedin_type"))).withColumn("linkedin_url", link)


def scrape_status(pages: Column, emails: Column) -> Column:
    """failed without a page, ok with an address, else partial."""
    return F.when(pages == 0, "failed").when(emails > 0, "ok").otherwise("partial")


def verdicts(addresses: DataFrame, mx: DataFrame, smtp: DataFrame, catchall: DataFrame) -> DataFrame:
    """(email, verdict) of addresses (email) from facts: mx (domain, …), smtp (email, code, refused), catchall (domain, probe)."""
    rows = addresses.select("email").distinct().withColumn("domain", email.domain(F.col("email")))
    has = mx.select("domain", F.lit(True).alias("m")).dropDuplicates(["domain"])
    s = smtp.select("email", email.smtp_class(F.col("code"), F.col("refused")).alias("s")).dropDuplicates(["email"])
    rows = rows.join(has, "domain", "left").join(s, "email", "left").join(catchall.select("domain", "probe").dropDuplicates(["domain"]), "domain", "left")
    ok = F.col("m").isNotNull()
    return rows.select("email", email.verdict(F.col("email"), ok, F.col("s"), email.catchall_class(F.col("probe"), ok)).alias("verdict"))


class Totals:
    """Totals of a scrape, counted by the jobs that write its facts: no table is read again for them.

    watch() each table that the job writes, write it, then ask total(). A job that fails after all counts nothing. Counts are
    numbers on the driver, one for each kind.
    """

    @staticmethod
    def counts() -> dict[str, dict[str, Column]]:
        n = F.count("*")
        return {
            "scrapes": {"n": n, **{s: F.count_if(F.col("status") == s) for s in ("ok", "partial", "failed")}, "seconds": F.sum("seconds")},
            "emails": {"emails": n},
            "phones": {"phones": n},
            "people": {"people": n, "linkedin_profiles": F.count_if(F.col("linkedin_type") == "profile"), "derived_emails": F.count_if(F.col("email_status") == "pattern-derived")},
            "socials": {"socials": n},
        }

    def __init__(self):
        self.seen: dict[str, Observation] = {}

    def watch(self, kind: str, rows: DataFrame) -> DataFrame:
        if kind in self.seen:
            raise ValueError(f"{kind} is watched already")
        self.seen[kind] = Observation()
        return rows.observe(self.seen[kind], *[c.alias(n) for n, c in self.counts()[kind].items()])

    def total(self) -> dict:
        """All counts of what was written; of kinds that weren't watched 0."""
        out = {n: 0 for counts in self.counts().values() for n in counts}
        for seen in self.seen.values():
            out |= {k: v or 0 for k, v in seen.get.items()}
        n, seconds = out["n"], out.pop("seconds")
        rate = Decimal(100 * (out["ok"] + out["partial"])) / n if n else None
        return out | {"success_rate": None if rate is None else float(rate.quantize(Decimal("0.1"), ROUND_HALF_UP)), "avg_seconds": round(float(seconds) / n, 3) if n else None}
