"""Keyed merges without MERGE: a full outer join with a policy for each column. Keys of the old table are never lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def new_value(new: Column, old: Column) -> Column:
    return new


def coalesced(new: Column, old: Column) -> Column:
    """The new value if there is one."""
    return F.coalesce(new, old)


def non_empty(new: Column, old: Column) -> Column:
    """The new value if it is a text that isn't empty."""
    return F.coalesce(F.nullif(new, F.lit("")), old)


def folded(new: DataFrame, keys: list[str], policies: dict, ord_col: str) -> DataFrame:
    """One row per key, as if the batch's rows had been merged one after the other: the last value, or the last that counts."""
    w = Window.partitionBy(*keys).orderBy(F.col(ord_col).desc())
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = new.withColumn("_rn", F.row_number().over(w))
    for c, policy in policies.items():
        if policy is coalesced:
            out = out.withColumn(c, F.first(c, ignorenulls=True).over(whole))
        elif policy is non_empty:
            out = out.withColumn(c, F.coalesce(F.first(F.nullif(c, F.lit("")), ignorenulls=True).over(whole), F.col(c)))
    return out.where("_rn = 1").drop("_rn")


def merged(old: DataFrame, new: DataFrame, keys: list[str], policies: dict, ord_col: str | None = None) -> DataFrame:
    """old with new merged in; policies give each other column's value where both have the key."""
    batch = folded(new, keys, policies, ord_col) if ord_col else new
    o = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in policies], F.lit(True).alias("_in_old"))
    n = batch.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in policies], F.lit(True).alias("_in_new"))
    both = o.join(n, keys, "full_outer")

    def value(c: str, policy) -> Column:
        a, b = F.col(f"_n_{c}"), F.col(f"_o_{c}")
        return F.when(F.col("_in_old").isNull(), a).when(F.col("_in_new").isNull(), b).otherwise(policy(a, b)).alias(c)

    return both.select(*keys, *[value(c, p) for c, p in policies.items()])


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those rows of new whose key old lacks; new holds each key once."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(*old.columns))
