"""Queues that a stream drains: each batch is a cycle and admits so many items of each queue, none twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .worker import _files, _run, folder

SCHEMA = "queue string, pos int, item string"


class Drain:
    """admit(taken, cursors) gives what a cycle takes, (queue, pos, item), knowing what earlier cycles took, (cycle, queue, pos, item), and how
    many items each queue has given.

    What was taken lies at at/taken, a folder for each cycle, and the cycle's number in the stream's checkpoint: a cycle that is run again after
    a failure takes the same, and a later process on the same folder goes on with the next.
    """

    def __init__(self, spark: SparkSession, admit: Callable[[DataFrame, dict[str, int]], DataFrame], at: str | None = None):
        self.spark, self.admit, self.at = spark, admit, at or folder(spark, "drain")

    def taken(self, before: int | None = None) -> DataFrame:
        fs, p = _files(self.spark, f"{self.at}/taken")
        if not fs.exists(p):
            return self.spark.createDataFrame([], f"cycle long, {SCHEMA}")
        rows = self.spark.read.schema(f"{SCHEMA}, cycle long").parquet(f"{self.at}/taken").select("cycle", "queue", "pos", "item")
        return rows if before is None else rows.where(F.col("cycle") < before)

    def _cycle(self, batch: DataFrame, epoch: int) -> None:
        taken = self.taken(before=epoch)
        cursors = {r.queue: r.n for r in taken.groupBy("queue").agg(F.count("*").alias("n")).collect()}  # a row for each queue
        self.admit(taken, cursors).coalesce(1).write.mode("overwrite").parquet(f"{self.at}/taken/cycle={epoch}")

    def run(self, ticks: DataFrame) -> DataFrame:
        """Cycles for the batches that have arrived; all that has been taken so far."""
        _run(ticks, self.at, self._cycle)
        return self.taken()
