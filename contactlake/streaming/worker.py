"""The worker as a stream: bounded micro-batches, merged state, a log, counters that survive a restart.

Whatever must survive lies in a folder that all executors share: the streams' checkpoints, and tables written as one
version per batch. A later process that is given the same folder goes on where the last one stopped.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder that all executors share; only where no such place is set, a local one that goes with the process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = tempfile.mkdtemp(prefix="contactlake-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
    return f"{at}/{tag}-{uuid.uuid4().hex[:12]}"


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Versions:
    """A table of which each batch writes a new version; the last complete one counts, older ones than the one before it go."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def epochs(self) -> list[int]:
        fs, at = _files(self.spark, self.path)
        if not fs.exists(at):
            return []
        done = [s.getPath() for s in fs.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith("epoch=")]
        jvm = self.spark.sparkContext._jvm
        return sorted(int(p.getName()[6:]) for p in done if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _at(self, epoch: int) -> str:
        return f"{self.path}/epoch={epoch:012d}"

    def read(self, before: int | None = None) -> DataFrame | None:
        told = [e for e in self.epochs() if before is None or e < before]
        return self.spark.read.parquet(self._at(told[-1])) if told else None

    def write(self, rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(self._at(epoch))
        for old in [e for e in self.epochs() if e < epoch][:-1]:
            fs, p = _files(self.spark, self._at(old))
            fs.delete(p, True)


def events_stream(spark: SparkSession, sf_dir: str, files_a_batch: int | None = None) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.parquet(f"{sf_dir}/events.parquet*")


def _run(rows: DataFrame, at: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    rows.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def log_rows(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("job"), F.when(F.col("event_type") == "error", "error").otherwise("info").alias("level"), F.to_json(F.struct("user_id", "value")).alias("payload"))


def append_log(events: DataFrame, spark: SparkSession, at: str | None = None) -> DataFrame:
    """Appends log rows to files, once each, and reads the log back."""
    at = at or folder(spark, "log")
    rows = log_rows(events)
    q = rows.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/rows")


def newest(log: DataFrame, keep: int = 300) -> DataFrame:
    return log.orderBy(F.col("id").desc()).limit(keep)


def counters(events: DataFrame, spark: SparkSession, at: str | None = None) -> DataFrame:
    """(job, n, errors): counts by job, kept in the stream's state and read from there; partitions count before they shuffle."""
    at = at or folder(spark, "counters")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    told = events.select(F.col("event_type").alias("job"), (F.col("event_type") == "error").cast("long").alias("failed"))
    counts = told.groupBy("job").agg(F.count("*").alias("n"), F.sum("failed").alias("errors"))
    counts.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    state = spark.read.format("statestore").load(f"{at}/state")  # named by their functions there
    return state.select(F.col("key.job").alias("job"), F.col("value.count").alias("n"), F.coalesce("value.sum", F.lit(0).cast("long")).alias("errors"))


def run_jobs(batch: DataFrame, jobs: dict) -> list[tuple[str, str | None, int | None]]:
    """(job, error, result) of each job over a batch: one that fails is noted and the rest go on. result: the number that the job gives, if any."""
    out = []
    for name, job in jobs.items():
        try:
            told = job(batch)
            out.append((name, None, told if isinstance(told, int) else None))
        except Exception as e:  # isolation is the point: the failure goes to the log
            out.append((name, f"{type(e).__name__}: {e}", None))
    return out


class CycleLog:
    """The log of a worker: a file for each cycle, and every `every` cycles one file of the newest `keep` rows in place of all before.

    So at most `every` + 1 files are kept, however long the worker runs. What a reader sees is the newest such file and the cycles after
    it; a process that ends between writing that file and removing the old ones loses and repeats nothing.
    """

    schema = "epoch long, pos int, job string, error string, result long"

    def __init__(self, spark: SparkSession, path: str, keep: int = 300, every: int = 64):
        self.spark, self.path, self.keep, self.every = spark, path, keep, every

    def _parts(self) -> tuple[dict[int, str], dict[int, str]]:
        """Paths by epoch: of cycles, and of files of the newest rows."""
        fs, at = _files(self.spark, self.path)
        cycles, newest = {}, {}
        for s in fs.listStatus(at) if fs.exists(at) else []:
            kind, _, epoch = s.getPath().getName().partition("=")
            if fs.exists(_files(self.spark, f"{s.getPath()}/_SUCCESS")[1]):
                (cycles if kind == "cycle" else newest)[int(epoch)] = s.getPath().toString()
        return cycles, newest

    def write(self, rows: DataFrame, epoch: int) -> None:
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cycle={epoch:012d}")
        if len(self._parts()[0]) > self.every:
            self.compact()

    def compact(self) -> None:
        cycles, newest = self._parts()
        last = max([*cycles, *newest])
        self.read().orderBy(F.col("epoch").desc(), F.col("pos").desc()).limit(self.keep).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/newest={last:012d}")
        for epoch, path in [*cycles.items(), *newest.items()]:
            if epoch <= last and not path.endswith(f"newest={last:012d}"):
                fs, p = _files(self.spark, path)
                fs.delete(p, True)

    def read(self) -> DataFrame:
        cycles, newest = self._parts()
        told = max(newest, default=-1)
        paths = [p for e, p in sorted(cycles.items()) if e > told] + ([newest[told]] if newest else [])
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)


class Heartbeat(StreamingQueryListener):
    """The last progress of each query, as a status."""

    def __init__(self):
        self.status: dict[str, dict] = {}

    def onQueryStarted(self, event):
        self.status[str(event.id)] = {"state": "started", "at": event.timestamp}

    def onQueryProgress(self, event):
        p = event.progress
        self.status[str(p.id)] = {"state": "running", "batch": p.batchId, "rows": p.numInputRows, "at": p.timestamp}

    def onQueryIdle(self, event):
        self.status.setdefault(str(event.id), {})["at"] = event.timestamp

    def onQueryTerminated(self, event):
        self.status.setdefault(str(event.id), {})["state"] = "stopped"


class Worker:
    """Starts once, stops, can be woken; runs its jobs on every micro-batch.

    at: the folder of its checkpoint, log and counters; a Worker on the same folder goes on with them. What the driver holds does not grow,
    nor do the files: the log keeps its newest `keep` rows.
    """

    def __init__(self, spark: SparkSession, events: DataFrame, jobs: dict, every: str = "12 seconds", at: str | None = None, keep: int = 300):
        self.spark, self.events, self.jobs, self.every = spark, events, jobs, every
        self.at, self.query, self.heartbeat = at or folder(spark, "worker"), None, None
        self.counted = Versions(spark, f"{self.at}/counters")  # a row for each job
        self.cycles = CycleLog(spark, f"{self.at}/log", keep)

    def _cycle(self, batch: DataFrame, epoch: int) -> None:
        batch.persist()  # the jobs share one read of the batch
        try:
            done = run_jobs(batch, self.jobs)
        finally:
            batch.unpersist()
        rows = self.spark.createDataFrame([(epoch, i, *x) for i, x in enumerate(done)], CycleLog.schema)
        self.cycles.write(rows, epoch)
        new = rows.groupBy("job").agg(F.count("*").alias("n"), F.count("error").alias("errors"))
        old = self.counted.read(before=epoch)
        self.counted.write(new if old is None else old.unionByName(new).groupBy("job").agg(F.sum("n").alias("n"), F.sum("errors").alias("errors")), epoch)

    def log(self) -> DataFrame:
        """(epoch, pos, job, error, result) of the newest rows, those of earlier processes on the same folder included."""
        return self.cycles.read()

    def counters(self) -> DataFrame:
        rows = self.counted.read()
        return rows if rows is not None else self.spark.createDataFrame([], "job string, n long, errors long")

    @property
    def running(self) -> bool:
        return bool(self.query and self.query.isActive)

    def start(self, once: bool = False):
        if not self.running:
            if self.heartbeat is None:
                self.heartbeat = Heartbeat()
                self.spark.streams.addListener(self.heartbeat)
            trigger = {"availableNow": True} if once else {"processingTime": self.every}
            self.query = self.events.writeStream.option("checkpointLocation", f"{self.at}/state").trigger(**trigger).foreachBatch(self._cycle).start()
        return self.query

    def wake(self) -> None:
        """A cycle now, over what has arrived; then on as before, or from now on if it was not running."""
        self.stop()
        self.start(once=True).awaitTermination()
        self.start()

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()
            self.query.awaitTermination()

    def close(self) -> None:
        self.stop()
        if self.heartbeat is not None:
            self.spark.streams.removeListener(self.heartbeat)
            self.heartbeat = None

    def status(self) -> dict:
        q = self.query
        beat = self.heartbeat.status.get(str(q.id), {}) if self.heartbeat and q else {}
        cycles = self.counters().agg(F.max("n")).first()[0] or 0  # each job has run in each
        return {"running": self.running, "cycles": cycles, "heartbeat": beat, "last": json.loads(q.lastProgress.json) if q and q.lastProgress else None}
