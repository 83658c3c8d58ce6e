"""Suppression: which companies a blocklist entry fits, and flags that follow from it.

The rules compare names, so no single key equals. Candidates come from equi-joins that between them cover every rule
(equal slug; an entry's longest word among the company's words; a single word against the words' prefixes; equal
domain slug), and the exact rule decides. The work grows with matches, not with companies times entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlake.functions.classify import matches_entry
from contactlake.functions.text import alnum_tokens, slug


def _keys(rows: DataFrame, keys: Column) -> DataFrame:
    return rows.withColumn("_k", F.explode(F.array_distinct(keys))).where("_k is not null")


def _tag(mark: str, c: Column) -> Column:
    return F.when(c != "", F.concat(F.lit(mark), c))


def company_keys(companies: DataFrame) -> DataFrame:
    """(company_id, cn, cd, _k): keys that between them cover every rule, from the company's side."""
    words = alnum_tokens(F.col("name"))
    prefixes = F.flatten(F.transform(F.filter(words, lambda w: F.length(w) >= 4), lambda w: F.transform(F.sequence(F.lit(4), F.length(w)), lambda n: F.concat(F.lit("p:"), F.substring(w, F.lit(1), n)))))
    of_company = F.concat(F.array(_tag("s:", slug(F.col("name"))), _tag("d:", slug(F.col("domain")))), F.transform(words, lambda w: F.concat(F.lit("w:"), w)), prefixes)
    return _keys(companies.select("id", "name", "domain"), of_company).select(F.col("id").alias("company_id"), F.col("name").alias("cn"), F.col("domain").alias("cd"), "_k")


def entry_keys(entries: DataFrame) -> DataFrame:
    """(entry_id, en, ed, _k): the same from the entry's side."""
    want = F.filter(alnum_tokens(F.col("name")), lambda w: F.length(w) >= 2)
    longest = F.aggregate(want, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    of_entry = F.array(_tag("s:", slug(F.col("name"))), _tag("d:", slug(F.coalesce("domain", F.lit("")))), _tag("w:", longest), F.when((F.size(want) == 1) & (F.length(longest) >= 4), F.concat(F.lit("p:"), longest)))
    return _keys(entries.select("id", "name", "domain"), of_entry).select(F.col("id").alias("entry_id"), F.col("name").alias("en"), F.col("domain").alias("ed"), "_k")


def met(c: DataFrame, e: DataFrame) -> DataFrame:
    """(company_id, entry_id) of every fit among rows that share a key."""
    return c.join(e, "_k").where(matches_entry(F.col("cn"), F.col("cd"), F.col("en"), F.col("ed"))).select("company_id", "entry_id").distinct()


def matches(companies: DataFrame, entries: DataFrame) -> DataFrame:
    """(company_id, entry_id) of every fit; companies have id, name, domain, entries id, name, domain."""
    return met(company_keys(companies), entry_keys(entries))


def flags(companies: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, was, blocked) of every company under the entries."""
    hit = matches(companies, entries).select(F.col("company_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    return companies.select("id", F.col("blocked").alias("was")).join(hit, "id", "left").select("id", "was", F.coalesce("_hit", F.lit(False)).alias("blocked"))


def remaining_after(companies: DataFrame, entries: DataFrame, removed: Column) -> DataFrame:
    """(id) of companies that only removed entries fit: they are unblocked."""
    before = matches(companies, entries.where(removed)).select("company_id").distinct()
    still = matches(companies, entries.where(~removed)).select("company_id").distinct()
    return before.join(still, "company_id", "left_anti").select(F.col("company_id").alias("id"))
