"""What survives a stop: streams and the worker go on where an earlier process left off."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from contactlake.streaming import state as st
from contactlake.streaming import worker as w

SF = "/root/testdata/sf0.001"


@pytest.fixture
def arriving(tmp_path):
    """A folder of events, and a function that lets the next half arrive."""
    table = pq.read_table(f"{SF}/events.parquet")
    half = table.num_rows // 2
    parts = iter((table.slice(0, half), table.slice(half)))
    folder = tmp_path / "events.parquet"
    folder.mkdir()

    def more() -> pa.Table:
        part = next(parts)
        pq.write_table(part, folder / f"part-{part.num_rows}-{id(part)}.parquet")
        return part

    return tmp_path, more


def events(spark, at):
    return w.events_stream(spark, str(at))


def test_tables_survive_a_restart(spark, arriving):
    at, more = arriving
    seen = lambda: spark.read.parquet(f"{at}/events.parquet")
    for _ in range(2):
        more()
        counted = {r.job: (r.n, r.errors) for r in w.counters(events(spark, at), spark, f"{at}/c").collect()}
        want = seen().groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("e")).collect()
        assert counted == {r.event_type: (r.n, r.e) for r in want}
        merged, _ = st.merged(events(spark, at).select("user_id", "event_id", "value"), ["user_id"], ["event_id", "value"], ["event_id"], f"{at}/m")
        want = {r.user_id: r.i for r in seen().groupBy("user_id").agg(F.max("event_id").alias("i")).collect()}
        assert {r.user_id: r.event_id for r in merged.collect()} == want
        assert w.append_log(events(spark, at), spark, f"{at}/l").count() == seen().count()
    # nothing new: nothing changes
    assert {r.job: (r.n, r.errors) for r in w.counters(events(spark, at), spark, f"{at}/c").collect()} == counted


def test_a_log_of_many_cycles_keeps_few_files(spark, tmp_path):
    log = w.CycleLog(spark, str(tmp_path / "log"), keep=30, every=8)
    for epoch in range(100):
        log.write(spark.createDataFrame([(epoch, p, f"job{p}", None, p) for p in range(4)], log.schema), epoch)
        assert len(list((tmp_path / "log").glob("*/*.parquet"))) <= 10
    log.write(spark.createDataFrame([(99, p, f"again{p}", None, p) for p in range(4)], log.schema), 99)  # a batch that is run again
    rows = log.read().orderBy(F.col("epoch").desc(), F.col("pos").desc()).limit(30).collect()
    assert [(r.epoch, r.pos) for r in rows] == [(e, p) for e in range(99, 0, -1) for p in (3, 2, 1, 0)][:30]
    assert len({(r.epoch, r.pos) for r in log.read().collect()}) == log.read().count()
    # a process that ended before it removed what the newest rows replace
    spark.createDataFrame([(50, 0, "old", None, 0)], log.schema).write.parquet(str(tmp_path / "log" / "cycle=000000000050"))
    assert log.read().where("epoch = 50").count() == 0


def test_worker_goes_on_in_a_new_process(spark, arriving):
    at, more = arriving

    def fail(batch):
        raise ValueError("no server")

    jobs = {"discover": lambda b: b.count(), "verify": fail}
    for cycle in range(2):
        part = more()
        k = w.Worker(spark, events(spark, at), jobs, at=f"{at}/worker")
        assert not k.running and not k.heartbeat
        k.start(once=True).awaitTermination()
        s = k.status()
        assert s["cycles"] == cycle + 1 and not s["running"] and s["last"]["numInputRows"] == part.num_rows
        assert {r.job: (r.n, r.errors) for r in k.counters().collect()} == {"discover": (cycle + 1, 0), "verify": (cycle + 1, cycle + 1)}
        assert k.log().where("error is not null").select("job").distinct().collect()[0].job == "verify"
        k.close()


def test_wake_start_and_stop(spark, arriving):
    at, more = arriving
    more()
    k = w.Worker(spark, events(spark, at), {"discover": lambda b: b.count()}, every="1 hour", at=f"{at}/worker")
    k.wake()
    assert k.running and k.start() is k.query and k.status()["cycles"] == 1
    more()
    k.wake()
    assert k.status()["cycles"] == 2 and k.running
    k.stop()
    assert not k.running
    k.close()
