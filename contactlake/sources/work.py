"""Work tables: what several later jobs read is computed once and written to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def removed(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _swept(spark: SparkSession, path: str) -> None:
    try:
        removed(spark, path)
    except Exception:  # the JVM may be gone already; then the cluster's own cleaning applies
        pass


def stored(rows: DataFrame, tag: str) -> DataFrame:
    """rows, written and read back; the files go when the session's process ends."""
    spark = rows.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = tempfile.mkdtemp(prefix="contactlake-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
    path = f"{at}/{tag}-{uuid.uuid4().hex[:12]}"
    atexit.register(_swept, spark, path)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
