"""Shared helpers: the shared work folder, table reading, word patterns."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII blanks: space and the five controls tab, newline, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: By application: folders written, and tables entered in the catalog.
_made: dict[str, list[str]] = {}
_tables: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores where hardly more partitions than cores read them, as a small table's do; larger inputs stay where they lie."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(2 * cores) if rows.rdd.getNumPartitions() <= 2 * cores else rows


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one only where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isDefined():
            return jsc.getCheckpointDir().get()
        at = tempfile.mkdtemp(prefix="contactlake-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(at)
        return jsc.getCheckpointDir().get()
    return at


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later jobs start there, whatever executors are lost.

    Files go with discard(), or when the session's process ends.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = []
        atexit.register(_sweep, spark, app)
    path = f"{shared_dir(spark)}/work-{app}/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    _made[app].append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def bucketed(df: DataFrame, key: str, tag: str, buckets: int | None = None) -> DataFrame:
    """Writes df to the shared folder in buckets of key, by default as many as there are shuffle partitions; joins on key then leave its rows where they are."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = []
        atexit.register(_sweep, spark, app)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{tag}_{uuid.uuid4().hex[:12]}"
    path = f"{shared_dir(spark)}/work-{app}/{name}"
    # dealt out as the buckets are, so each task writes one file
    df.repartition(n, key).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(name)
    _made[app].append(path)
    _tables.setdefault(app, []).append(name)
    return spark.table(name)


def discard(df: DataFrame) -> None:
    """Drops the files of a stored() table that nothing reads any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        _delete(df.sparkSession, path)


def _sweep(spark: SparkSession, app: str) -> None:
    try:
        for name in _tables.pop(app, []):
            spark.sql(f"drop table if exists {name}")
        for path in _made.pop(app, []):
            _delete(spark, path)
    except Exception:  # the JVM may be gone already; then the cluster's own cleaning applies
        pass


def lower_ascii(c):
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def blank_words(c):
    """Array of the words between ASCII blanks; null or blank text gives an empty array."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), BLANK_RE), "")


def let(value, body):
    """body(value) with value computed once per row (Catalyst would inline it into lambdas)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def release(spark: SparkSession) -> None:
    """Lets the driver drop what no plan refers to any more, so Spark deletes the shuffle files behind it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
