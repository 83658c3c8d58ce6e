"""Conventions and derived addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlake.functions import email

from .keep import mode_first_seen


def pattern_votes(emails: DataFrame) -> DataFrame:
    """(company_id, pattern): the convention most bare addresses show; of equals the one listed first."""
    rows = emails.select("company_id", email.inferred_from_local(F.col("email")).alias("pattern")).where("pattern is not null")
    rank = F.array_position(F.array(*map(F.lit, email.PATTERNS)), F.col("pattern"))
    n = rows.groupBy("company_id", "pattern").agg(F.count("*").alias("n"))
    return n.groupBy("company_id").agg(F.max_by("pattern", F.struct(F.col("n"), -rank)).alias("pattern"))


def derived(people: DataFrame, emails: DataFrame, default: str = "first.last") -> DataFrame:
    """(id, company_id, email, email_status): addresses for people without one, by the company's convention and commonest domain; published or invalid ones are left out."""
    domains = mode_first_seen(emails, "company_id", email.domain(F.col("email")), "id").select("company_id", F.col("value").alias("domain"))
    parts = email.name_parts(F.col("name"))
    rows = people.where("email is null").join(domains, "company_id").join(pattern_votes(emails), "company_id", "left")
    local = email.applied(F.coalesce("pattern", F.lit(default)), F.get(parts, F.lit(0)), F.element_at(parts, -1))
    made = rows.where(F.size(parts) >= 2).select("id", "company_id", F.concat(local, F.lit("@"), "domain").alias("email"))
    return made.where(email.valid(F.col("email"))).join(emails.select("company_id", "email"), ["company_id", "email"], "left_anti").select("id", "company_id", "email", F.lit("pattern-derived").alias("email_status"))


def verified_people(people: DataFrame, facts: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, email, email_status) after verification. facts: (email, verdict); candidates: (id, pos, email).

    The winner among a person's candidates is the first deliverable one, else the first catch-all, else the first that has
    a mail server.
    """
    tried = candidates.join(facts.select("email", F.col("verdict").alias("v")), "email").where(F.col("v").isin("deliverable", "catchall", "mx-ok"))
    won = tried.groupBy("id").agg(F.min_by(F.struct("email", "v"), F.struct(email.verdict_rank(F.col("v")), "pos")).alias("w")).select("id", F.col("w.email").alias("winner"), F.col("w.v").alias("winner_verdict"))
    rows = people.join(facts, "email", "left").join(won, "id", "left")
    lost = F.col("email").isNull() | F.col("verdict").isin("rejected", "invalid", "disposable")
    status = email.saved_status(F.lit(True), F.col("email"), F.col("verdict"), F.col("email_status"), F.col("winner_verdict"))
    return rows.select("id", F.when(lost, F.col("winner")).otherwise(F.col("email")).alias("email"), status.alias("email_status"))
