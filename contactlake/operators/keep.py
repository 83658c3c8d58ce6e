"""Keep-first, keep-last and top-k by key: windows with a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list, order: list, k: int = 1, keep: str | None = None) -> DataFrame:
    """The first k rows of each key; keep: a column for their place, from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    return out.withColumnRenamed("_rn", keep) if keep else out.drop("_rn")


def keep_first(df: DataFrame, keys: list, ord_col: str = "ord") -> DataFrame:
    return ranked(df, keys, [F.col(ord_col).asc()])


def keep_last(df: DataFrame, keys: list, ord_col: str = "ord") -> DataFrame:
    return ranked(df, keys, [F.col(ord_col).desc()])


def mode_first_seen(df: DataFrame, by: str, value: Column, ord_col: str = "ord") -> DataFrame:
    """(by, value, n) of the commonest value; of equals the one seen first."""
    n = df.where(value.isNotNull()).groupBy(by, value.alias("value")).agg(F.count("*").alias("n"), F.min(ord_col).alias("first"))
    return n.groupBy(by).agg(F.max_by(F.struct("value", "n"), F.struct(F.col("n"), -F.col("first"))).alias("x")).select(by, F.col("x.value").alias("value"), F.col("x.n").alias("n"))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")
