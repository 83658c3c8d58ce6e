"""Tables in buckets of a key, written copy-on-write: an upsert rewrites the buckets that its batch touches and no others."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from contactlake.operators.merge import folded, merged
from contactlake.sources.work import removed

BUCKET = "_bucket"


class BucketedTable:
    """A Parquet table at path, partitioned by a hash of the columns `by` into `buckets` folders of one file each, or of several
    where a bucket is large; rows lie in the order of `by`.

    keys: what makes a row; by: some of them, so that equal keys share a bucket and facts of one company lie together. An upsert
    computes its batch once, into a folder beside the table. Then one job follows: the touched folders are read, merged with the batch and put in
    place of the old ones when the job commits; if it fails before, nothing has changed. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], by: list[str] | None = None, buckets: int = 64):
        self.spark, self.path, self.keys, self.by, self.buckets = spark, path, keys, by or keys, buckets
        self.schema = spark.createDataFrame([], schema).schema
        if missing := {*keys, *self.by} - {*self.schema.names}:
            raise ValueError(f"no columns {sorted(missing)}")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def _at(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self) -> bool:
        fs, path = self._at(self.path)
        return fs.exists(path)

    def _stored(self) -> DataFrame:
        if not self.exists():
            return self.spark.createDataFrame([], self.schema).withColumn(BUCKET, F.lit(0))
        return self.spark.read.schema(StructType([*self.schema.fields, StructField(BUCKET, IntegerType())])).parquet(self.path)

    def read(self, of: DataFrame | None = None) -> DataFrame:
        """The table, or its buckets that rows of `of` (with the columns `by`) fall into."""
        rows = self._stored()
        if of is not None:
            rows = rows.where(F.col(BUCKET).isin(self.touched(of)))
        return rows.select(*self.schema.names)

    def touched(self, batch: DataFrame) -> list[int]:
        """Buckets of the batch's rows: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in batch.select(self.bucket()).distinct().collect())

    def _put(self, rows: DataFrame) -> None:
        told = rows.select(*self.schema.names).withColumn(BUCKET, self.bucket()).hint("rebalance", BUCKET)
        told.sortWithinPartitions(BUCKET, *self.by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def _first(self, batch: DataFrame, policies: dict[str, Callable], ord_col: str | None) -> list[int]:
        """The batch as a new table: there is nothing to merge it with."""
        self._put(folded(batch, self.keys, policies, ord_col) if ord_col else batch)
        fs, path = self._at(self.path)
        return sorted(int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(path) if x.isDirectory() and x.getPath().getName().startswith(f"{BUCKET}="))

    def upsert(self, batch: DataFrame, policies: dict[str, Callable], ord_col: str | None = None) -> list[int]:
        """Merges the batch by keys, with a policy for each other column; gives the buckets rewritten."""
        if not self.exists():
            return self._first(batch, policies, ord_col)
        path = f"{self.path}-batch-{uuid.uuid4().hex[:12]}"
        try:
            batch.write.parquet(path)
            batch = self.spark.read.schema(batch.schema).parquet(path)
            at = self.touched(batch)
            if at:
                old = self._stored().where(F.col(BUCKET).isin(at)).drop(BUCKET)
                self._put(merged(old, batch, self.keys, policies, ord_col))
            return at
        finally:
            removed(self.spark, path)

    def delete(self, keys: DataFrame) -> list[int]:
        """Removes rows by key; gives the buckets rewritten. A bucket left without rows goes as a whole."""
        at = self.touched(keys)
        if at:
            old = self._stored().where(F.col(BUCKET).isin(at)).drop(BUCKET)
            left = old.join(keys.select(*self.keys).distinct(), self.keys, "left_anti")
            kept = [r[0] for r in left.select(self.bucket()).distinct().collect()]
            if kept:
                self._put(left.where(self.bucket().isin(kept)))
            for b in sorted({*at} - {*kept}):
                removed(self.spark, f"{self.path}/{BUCKET}={b}")
        return at
