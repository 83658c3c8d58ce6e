"""State machines on the state store: batches cut anywhere, out-of-order and late rows, restarts, and how much a batch writes."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from contactlake.streaming import state as s

T0 = datetime.datetime(2024, 1, 1)
END = {"ts": datetime.datetime(2200, 1, 1)}


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def stream(spark, path, batches, schema):
    """One file for each batch, in turn."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/arrived")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/arrived")


def files(path, kind="*.parquet"):
    return list((path / "rows").glob(kind))


TRIES = "key long, ts timestamp, n long, status int"


def told(df):
    return sorted(tuple(r) for r in df.collect())


def plain_breaker(rows, misses=3, enough=4, cooldown=None):
    out, by_key = [], {}
    for key, ts, n, found, bad in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        missed, known, since = by_key.get(key, (0, set(), None))
        if since is not None and cooldown is not None and ts >= since + datetime.timedelta(seconds=cooldown):
            missed, known, since = 0, set(), None
        if since is None:
            out.append(n)
            missed, known = (missed + 1, known) if bad else (0, known | {found})
            since = ts if missed >= misses or len(known) >= enough else None
        by_key[key] = missed, known, since
    return sorted(out)


@pytest.mark.parametrize("cooldown", [None, 400])
def test_breaker_cut_anywhere_and_out_of_order(spark, tmp_path, cooldown):
    r = random.Random(1)
    rows = [(r.randrange(4), at(60 * i + r.randrange(50)), i, r.randrange(9), r.random() < 0.5) for i in range(160)]
    want = plain_breaker(rows, cooldown=cooldown)
    late = sorted(rows, key=lambda x: x[1] + datetime.timedelta(seconds=r.randrange(1500)))  # within the delay
    batches = [late[:7], late[7:90], late[90:91], late[91:], [(None, END["ts"], None, None, None)]]
    events = stream(spark, str(tmp_path), batches, "key long, ts timestamp, n long, found long, bad boolean")
    got = s.in_order(events, s.Breaker(cooldown=cooldown), str(tmp_path), "1 hour")
    assert sorted(x.n for x in got.where("what = 'asked'").collect()) == want
    opened, closed = (got.where(F.col("what") == x).count() for x in ("opened", "closed"))
    assert opened > 0 and closed == (opened if cooldown else 0)  # the last row's time closes them all


def test_backoff_tells_the_next_try_and_drops_what_is_too_late(spark, tmp_path):
    again = (429, 503)
    events = [
        [(1, at(0), 1, 429), (2, at(0), 2, 200), (3, at(0), 3, None), (4, at(10), 4, 503)],
        [(1, at(1), 5, 200), (4, at(9), 6, 429), (3, at(100), 7, 503)],  # 4: out of order; 1: before its next try is due
        [(9, at(7200), 8, 404)],
        [(9, at(7201), 10, 200)],
        [(3, at(101), 9, 200)],  # far behind the watermark that the batch before had
        [(None, END["ts"], None, None)],
    ]
    got = s.in_order(stream(spark, str(tmp_path), events, TRIES), s.Backoff(again), str(tmp_path), "10 minutes")
    at_s = lambda x: (x - int(T0.timestamp() * s.SECOND)) / s.SECOND
    answers = sorted((x.key, x.tries, x.status, at_s(x.at), x.waited / s.SECOND, x.failed) for x in got.where("what = 'answer'").collect())
    assert answers == [(1, 1, 429, 0, 0, False), (1, 2, 200, 1, 1.5, False), (2, 1, 200, 0, 0, False), (3, 1, None, 0, 0, True), (3, 2, 503, 100, 1.5, False), (4, 1, 429, 9, 0, False), (4, 2, 503, 10, 1.5, False), (9, 1, 404, 7200, 0, False)]
    due = sorted((x.key, x.tries, at_s(x.at)) for x in got.where("what = 'due'").collect())
    assert due == [(3, 2, 1.5), (3, 3, 103), (4, 3, 13)]


def test_memo_looks_up_once_while_alive_and_again_after(spark, tmp_path):
    schema = "key string, ts timestamp, n long"
    path = str(tmp_path)
    first = stream(spark, path, [[("a", at(0), 1), ("b", at(5), 2)], [("a", at(59), 3)], [("a", at(60), 4), ("b", at(400), 5)]], schema)
    told_first = s.in_order(first, s.Memo(ttl=60), path, "1 second").count()
    # a second process on the same folder
    second = stream(spark, path, [[("a", at(100), 6), ("a", at(500), 7)], [(None, END["ts"], None)]], schema)
    got = s.in_order(second, s.Memo(ttl=60), path, "1 second")
    looked = sorted((x.key, (x.at - int(T0.timestamp() * s.SECOND)) // s.SECOND, x.uses) for x in got.collect())
    # the row at 100 is behind the watermark of 399
    assert looked == [("a", 0, 2), ("a", 60, 1), ("a", 500, 1), ("b", 5, 1), ("b", 400, 1)] and told_first < len(looked)


def test_merged_over_restarts_writes_what_a_batch_touches(spark, tmp_path):
    schema = "k long, part string, n long, value double"
    path = str(tmp_path)
    whole = [(i, "x", i, float(i)) for i in range(3000)]
    table, _ = s.merged(stream(spark, path, [whole[:1500], whole[1500:]], schema), ["k", "part"], ["n", "value"], ["n"], path)
    assert table.count() == 3000
    before = {f.name for f in files(tmp_path)}
    few = [(7, "x", 9000, -1.0), (7, "x", 9001, -2.0), (8, "x", 1, -3.0), (9999, None, 5, None)]  # 8: older than what is kept
    table, changes = s.merged(stream(spark, path, [few], schema), ["k", "part"], ["n", "value"], ["n"], path)
    got = {(x.k, x.part): (x.n, x.value) for x in table.collect()}
    want = {(i, "x"): (i, float(i)) for i in range(3000)} | {(7, "x"): (9001, -2.0), (9999, None): (5, None)}
    assert got == want
    new = [f for f in files(tmp_path) if f.name not in before]
    assert spark.read.parquet(*map(str, new)).count() == 2 and changes.count() == 3002


def test_a_key_of_many_rows_asks_the_store_a_fixed_number_of_times():
    """However many rows a batch brings of a key, waiting and telling them takes as many calls."""

    class Store:
        def __init__(self):
            self.values, self.calls, self.timers = [], 0, set()

        def called(self, f):
            def run(*x):
                self.calls += 1
                return f(*x)

            return run

        def __getattr__(self, name):
            put = lambda x: setattr(self, "values", list(x))
            return self.called({"appendValue": lambda x: self.values.append(x), "get": lambda: iter(self.values), "put": put, "clear": lambda: put([]), "registerTimer": self.timers.add}[name])

    class Kept(Store):
        def __getattr__(self, name):
            return self.called({"get": lambda: self.values[0] if self.values else None, "update": lambda x: setattr(self, "values", [x]), "clear": lambda: setattr(self, "values", [])}[name])

    class Handle(Store):
        def getListState(self, name, schema):
            self.waiting = Store()
            return self.waiting

        def getValueState(self, name, schema):
            self.state = Kept()
            return self.state

    class Now:
        def getCurrentWatermarkInMs(self):
            return 10_000_000

    def calls(n):
        h, m = Handle(), s.Memo(ttl=60)
        m.init(h)
        list(m.handleInputRows(("a",), iter([{"at": i * s.SECOND, "n": i} for i in range(n)]), Now()))
        told = [tuple(r) for r in m.handleExpiredTimer(("a",), Now(), None)]
        assert [r[1:] for r in told] == [(60 * k * s.SECOND, 60) for k in range(n // 60)]
        return h.calls + h.waiting.calls + h.state.calls, len(h.timers)

    assert calls(6000) == calls(60)


def test_parts_are_batches_of_files_that_no_task_writes_alone(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id as n", "timestamp_micros(id * 1000000) as ts")
    for name, by in (("n", "n"), ("ts", s.micros("ts"))):
        at = str(tmp_path / name)
        got = s.arrived(rows, by, 4, at, END, most=100)
        seen = []
        got.writeStream.foreachBatch(lambda b, _: seen.append(sorted(x.n for x in b.select("n").collect() if x.n is not None))).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()  # noqa: B023
        assert seen == [list(range(250 * k, 250 * (k + 1))) for k in range(4)] + [[]]
        assert len(list((tmp_path / name / "arrived").glob("*.parquet"))) == 4 * 3 + 1


def test_few_rows_in_many_files(spark, tmp_path):
    """Parts of unequal size are batches of their own, though some leave files out."""
    rows = spark.createDataFrame([(i,) for i in [*range(90), 300]], "n long")
    seen = []
    got = s.arrived(rows, "n", 2, str(tmp_path), most=10)
    got.writeStream.foreachBatch(lambda b, _: seen.append(b.count())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert seen == [90, 1]


def test_events_whose_ids_run_against_their_time_all_count(spark, tmp_path):
    """Later ids of earlier times, as in a table repeated with shifted keys: the stream takes them in the order of time, so none is late."""
    import duckdb

    from contactlake.plans.catalog import ORACLES, QUERIES
    from tests.compare import differences, duck

    source = "/root/testdata/sf0.001/events.parquet"
    duckdb.connect().execute(f"copy (select e.* replace (event_id + i * 1000000 as event_id, user_id + i * 100000 as user_id) from '{source}' e, range(3) r(i)) to '{tmp_path}/events.parquet' (format parquet)")
    assert differences(spark, duck(str(tmp_path)), QUERIES["stream_domain_cache"], ORACLES["stream_domain_cache"], str(tmp_path)) is None
