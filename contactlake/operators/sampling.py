"""Row samples that follow from an order, without one task seeing all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def positions(df: DataFrame, order: list, name: str = "_pos") -> DataFrame:
    """A gapless number from 0 in the given order: ranges are sorted apart, then shifted by the sizes of those before."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    # the number within a range follows the sort; the range's own start comes from a count per range
    within = Window.partitionBy("_part").orderBy(*order)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return parts.withColumn("_rn", F.row_number().over(within) - 1).join(F.broadcast(starts), F.col("_part") == F.col("_p")).withColumn(name, F.col("_rn") + F.col("_start")).drop("_part", "_p", "_start", "_rn", "_mid")


def stride_sample(df: DataFrame, order: list, k: int) -> DataFrame:
    """Every (n div k)-th row in the order, k of them at most."""
    total = df.count()
    step = max(1, total // k)
    return positions(df, order).where((F.col("_pos") % step == 0) & (F.floor(F.col("_pos") / step) < k)).drop("_pos")
