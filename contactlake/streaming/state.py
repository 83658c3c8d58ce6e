"""Keyed state machines on Spark's state store: rows of a key wait until the watermark has passed them and are then taken
in order, so results don't depend on how the stream is cut into batches, nor on the order of rows within the watermark's delay.

What must survive lies in a folder that all executors share: at/state, the stream's checkpoint with the state store, and at/rows,
the files that each batch adds. A later process that is given the same folder goes on where the last one stopped.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

import contactlake.streaming

from .worker import ROCKS, _files, folder

# the machines travel to executors with the task
cloudpickle.register_pickle_by_value(contactlake.streaming)

SECOND = 1_000_000
#: Fixed: answers that are worth another try.
RETRYABLE = (429, 500, 502, 503, 504)


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


class Latest(StatefulProcessor):
    """Keeps the row of highest order of each key; tells each change."""

    def __init__(self, keys: list[str], fields: list[str], kinds: str, order: list[str]):
        self.keys, self.fields, self.kinds, self.order = keys, fields, kinds, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", self.kinds)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rank = lambda r: tuple((r[c] is not None, r[c]) for c in self.order)
        old = Row(*self.fields)(*self.latest.get()) if self.latest.exists() else None
        best = max(rows, key=rank)
        if old is None or rank(best) > rank(old):
            values = tuple(best[c] for c in self.fields)
            self.latest.update(values)
            yield Row(*self.keys, *self.fields)(*key, *values)

    def close(self) -> None:
        pass


class InOrder(StatefulProcessor):
    """Rows (at, n, …) of a key, at in microseconds, wait until the watermark has passed them and then go to step() by (at, n).

    What a batch brings of a key waits as one value, and one timer stands for the earliest of it, so that the store is asked a fixed
    number of times for a key and batch, however many rows they hold.

    kinds: the waiting columns as DDL, at and n first; machine: what step() keeps, as DDL. step() gets the kept values, or None, and a row, and
    gives what is kept and the rows to tell. due() tells when time alone changes what is kept, and elapse() how.
    """

    kinds = machine = schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = _names(self.kinds)
        self.waiting = handle.getListState("waiting", "rows binary")
        self.kept = handle.getValueState("kept", self.machine)

    def _known(self) -> tuple | None:
        values = self.kept.get()
        return None if values is None else tuple(values)

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def step(self, key: tuple, kept: tuple | None, row: tuple) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def due(self, kept: tuple | None) -> int | None:
        return None

    def elapse(self, key: tuple, kept: tuple) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        came = [tuple(r[c] for c in self.names) for r in rows]
        self.waiting.appendValue((pickle.dumps(came),))
        self._wake(min(r[0] for r in came))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [r for (packed,) in self.waiting.get() for r in pickle.loads(packed)]
        ready = sorted((r for r in rows if r[0] <= now), key=lambda r: (r[0], r[1]))
        before = kept = self._known()
        if not ready and self.due(kept) is None:
            return  # another timer of this watermark has done it
        later = [r for r in rows if r[0] > now]
        if later:
            if ready:
                self.waiting.put([(pickle.dumps(later),)])
            self._wake(min(r[0] for r in later))
        elif rows:
            self.waiting.clear()
        told: list[tuple] = []

        def lapsed(until: int, kept: tuple | None) -> tuple | None:
            while (at := self.due(kept)) is not None and at <= until:
                kept, more = self.elapse(key, kept)
                told.extend(more)
            return kept

        for row in ready:
            kept, more = self.step(key, lapsed(row[0], kept), row)
            told.extend(more)
        kept = lapsed(now, kept)
        if kept is None:
            if before is not None:
                self.kept.clear()
        elif kept != before:
            self.kept.update(kept)
        if (at := self.due(kept)) is not None:
            self._wake(at)
        tells = Row(*_names(self.schema))
        for t in told:
            yield tells(*t)

    def close(self) -> None:
        pass


class Breaker(InOrder):
    """Lets a client's queries through until `misses` in a row fail or `enough` different things are found; then it is open, for good
    or until `cooldown` seconds have passed."""

    kinds, machine = "at long, n long, found long, bad boolean", "misses int, found array<long>, since long"
    schema = "key long, at long, n long, what string"

    def __init__(self, misses: int = 3, enough: int = 4, cooldown: int | None = None):
        self.misses, self.enough, self.cooldown = misses, enough, cooldown

    def due(self, kept):
        return kept[2] + self.cooldown * SECOND if kept and kept[2] is not None and self.cooldown is not None else None

    def elapse(self, key, kept):
        return None, [(key[0], self.due(kept), None, "closed")]

    def step(self, key, kept, row):
        at, n, found, bad = row
        missed, known, since = kept or (0, [], None)
        if since is not None:
            return kept, []
        missed, known = (missed + 1, known) if bad else (0, sorted({*known, found}))
        full = missed >= self.misses or len(known) >= self.enough
        return (missed, known, at if full else None), [(key[0], at, n, "asked")] + ([(key[0], at, None, "opened")] if full else [])


class Backoff(InOrder):
    """A client's tries: one without an answer, or with one of `again`, is followed by the next, `retries` times at most, after
    `step` microseconds times its number; a timer tells that the next try is due, if its answer has not come before."""

    kinds, machine = "at long, n long, status int", "tries int, done boolean, next long"
    schema = "key long, what string, at long, status int, tries int, waited long, failed boolean"

    def __init__(self, again: tuple[int, ...] = RETRYABLE, retries: int = 2, wait: int = 1_500_000):
        self.again, self.retries, self.wait = again, retries, wait

    def due(self, kept):
        return kept[2] if kept else None

    def elapse(self, key, kept):
        tries, done, at = kept
        return (tries, done, None), [(key[0], "due", at, None, tries + 1, None, None)]

    def step(self, key, kept, row):
        at, _, status = row
        tries, done, _ = kept or (0, False, None)
        if done:
            return kept, []
        waited = self.wait * tries * (tries + 1) // 2
        tries += 1
        done = tries > self.retries or not (status is None or status in self.again)
        return (tries, done, None if done else at + self.wait * tries), [(key[0], "answer", at, status, tries, waited, status is None)]


class Memo(InOrder):
    """Whether a key must be looked up: at its first use, and again at the first use when `ttl` seconds have passed since. A key that is not
    used any more leaves the state when its time has passed."""

    kinds, machine = "at long, n long", "since long, uses long"
    schema = "key string, at long, uses long"

    def __init__(self, ttl: int):
        self.ttl = ttl

    def due(self, kept):
        return kept[0] + self.ttl * SECOND if kept else None

    def elapse(self, key, kept):
        return None, [(key[0], *kept)]

    def step(self, key, kept, row):
        return ((row[0], 1) if kept is None else (kept[0], kept[1] + 1)), []


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _run(rows: DataFrame, at: str) -> DataFrame:
    """Runs the stream over what has arrived; the rows that it has told so far."""
    spark = rows.sparkSession
    rows.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/rows")


def _kept(rows: DataFrame, key: str, machine: StatefulProcessor, schema: str, time: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return rows.groupBy(key).transformWithState(machine, schema, "append", time)


def in_order(rows: DataFrame, machine: InOrder, at: str | None = None, delay: str = "1 hour") -> DataFrame:
    """What the machine tells of a stream of (key, ts, n, …): rows up to `delay` late count in their place, later ones are dropped
    by the watermark; rows that the watermark has not passed yet are told by a later run."""
    at = at or folder(rows.sparkSession, type(machine).__name__.lower())
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).withColumn("at", micros("ts"))
    return _run(_kept(timed, "key", machine, machine.schema, "eventTime"), at)


def merged(rows: DataFrame, keys: list[str], fields: list[str], order: list[str], at: str) -> tuple[DataFrame, DataFrame]:
    """(table, changes) of a stream merged by keys: the table is the state itself, read from the store; changes are the rows that
    batches have changed. A batch writes the keys it touches and no others."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    ddl = lambda names: ", ".join(f"`{c}` {kinds[c]}" for c in names)
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    machine = Latest(keys, fields, ddl(fields), order)
    changes = _run(rows.select(*keys, *fields).groupBy(*keys).transformWithState(machine, f"{ddl(keys)}, {ddl(fields)}", "append", "none"), at)
    return stored_state(spark, at, "latest"), changes


def stored_state(spark: SparkSession, at: str, name: str) -> DataFrame:
    """Keys and values of a state as the last batch left them."""
    return spark.read.format("statestore").option("path", f"{at}/state").option("stateVarName", name).load().select("key.*", "value.*")


def arrived(rows: DataFrame, by: str | Column, parts: int, at: str, last: dict | None = None, most: int = 500_000) -> DataFrame:
    """A stream of rows that arrive in `parts` batches one after the other, cut by ranges of a column; then, if given, a row `last`.

    Each part is the same number of files, enough for about `most` rows in one; a batch takes them all.
    """
    spark = rows.sparkSession
    by = F.col(by) if isinstance(by, str) else by
    low, high, n = rows.agg(F.min(by), F.max(by), F.count("*")).first()
    part = F.lit(0) if low is None else F.least(F.floor((by - F.lit(low)) * parts / F.lit(high - low + 1)), F.lit(parts - 1))
    files = max(1, -(-n // (parts * most)))

    def put(some: DataFrame) -> None:
        some.write.mode("append").parquet(f"{at}/arrived")

    for k in range(parts):
        had = _number_of_files(spark, f"{at}/arrived")
        some = rows.where(part == k)
        put(some.coalesce(1) if files == 1 else some.repartition(files))
        for _ in range(had + files - _number_of_files(spark, f"{at}/arrived")):  # files that few rows left out
            put(rows.limit(0).coalesce(1))
    if last:
        put(spark.range(1).select(*[F.lit(last.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema]).coalesce(1))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{at}/arrived")


def _number_of_files(spark: SparkSession, path: str) -> int:
    fs, p = _files(spark, path)
    return sum(s.getPath().getName().endswith(".parquet") for s in fs.listStatus(p)) if fs.exists(p) else 0
