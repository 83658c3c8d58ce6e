"""Suppression kept up to date: how many entries fit each company, changed by what changed of the blocklist.

A change of entries reads the companies' keys in the buckets of the entries' own keys, and rewrites the counts of companies
that these entries fit; the rest of the directory is not looked at.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactlake.operators.blocklist import company_keys, entry_keys, met
from contactlake.operators.merge import new_value
from contactlake.sources.buckets import BucketedTable
from contactlake.sources.work import removed


def _added(new: Column, old: Column) -> Column:
    return new + old


class Suppression:
    """State at a folder: companies' keys in buckets of the key, entries by id, supports (company_id, n) by company."""

    def __init__(self, spark: SparkSession, at: str, buckets: int = 64):
        self.spark, self.at = spark, at
        self.index = BucketedTable(spark, f"{at}/keys", "company_id long, cn string, cd string, _k string", ["company_id", "_k"], ["_k"], buckets)
        self.entries = BucketedTable(spark, f"{at}/entries", "id long, name string, domain string", ["id"], buckets=buckets)
        self.supports = BucketedTable(spark, f"{at}/supports", "company_id long, n long", ["company_id"], buckets=buckets)

    def _fits(self, entries: DataFrame) -> DataFrame:
        """(company_id, entry_id); only the index's buckets of these entries' keys are read, and of them the kinds of keys (four) that the entries have."""
        wanted = entry_keys(entries)
        kinds = sorted(r[0] for r in wanted.select(F.substring("_k", 1, 2)).distinct().collect())
        return met(self.index.read(of=wanted).where(reduce(Column.__or__, (F.col("_k").startswith(k) for k in kinds), F.lit(False))), wanted)

    def _count(self, fits: DataFrame, sign: int) -> list[int]:
        return self.supports.upsert(fits.groupBy("company_id").agg((F.count("*") * sign).alias("n")), {"n": _added})

    def add_companies(self, companies: DataFrame) -> None:
        """Companies (id, name, domain) that are new; null names and domains have no keys."""
        self.index.upsert(company_keys(companies), {"cn": new_value, "cd": new_value})
        known = self.entries.read()
        if not known.isEmpty():
            self._count(met(company_keys(companies), entry_keys(known)), 1)

    def add(self, entries: DataFrame) -> list[int]:
        """Entries (id, name, domain); those whose id is known change nothing. The buckets of supports rewritten."""
        told = entries.select("id", "name", "domain").dropDuplicates(["id"])
        path = f"{self.at}/new-{uuid.uuid4().hex[:12]}"
        try:
            told.join(self.entries.read(of=told).select("id"), "id", "left_anti").write.parquet(path)
            new = self.spark.read.schema(told.schema).parquet(path)
            at = self._count(self._fits(new), 1)
            self.entries.upsert(new, {"name": new_value, "domain": new_value})
            return at
        finally:
            removed(self.spark, path)

    def remove(self, entries: DataFrame) -> list[int]:
        """Entries by id; those that aren't known change nothing. The buckets of supports rewritten."""
        gone = self.entries.read(of=entries).join(entries.select("id").distinct(), "id", "left_semi")
        at = self._count(self._fits(gone), -1)
        self.entries.delete(entries.select("id"))
        return at

    def flags(self, companies: DataFrame) -> DataFrame:
        """(id, blocked) of the companies: whether any entry supports it."""
        n = self.supports.read().select(F.col("company_id").alias("id"), "n")
        return companies.select("id").join(n, "id", "left").select("id", (F.coalesce("n", F.lit(0).cast("long")) > 0).alias("blocked"))
