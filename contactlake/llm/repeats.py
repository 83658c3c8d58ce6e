"""Where the same run of symbols (bytes, words) occurs again: the parts shared by the two repeat operators.

A window is `window` symbols of one document. Of the grams of `gram` symbols in a window the one with the smallest
hash is its anchor (the leftmost of equals). Equal windows have equal anchors at equal places, so windows need only
be compared under the same anchor hash. Neighbouring windows share an anchor; such a run is one row. A run equal to
an earlier one as a whole is repeated as a whole. What is left are anchors with several different runs; only their
text is looked at again, by the caller's engine, one bounded chunk at a time. Whatever is held to be equal without a
look at the text agrees in two hashes of 64 bits each, of different symbols' values, besides the anchor's.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed, release, stored
from .shingles import binary, mix

_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 2**64)
_INDEX = np.uint64(2**24 - 1)
U = np.uint64


@dataclass(frozen=True)
class Layout:
    """within: a window may repeat one of its own document. hot: runs under an anchor from which on windows are
    matched one by one through grouped minima instead of by the engine. block: symbols hashed at a time, under 2^24.
    chunk: bytes of text the engine takes at a time."""

    window: int
    gram: int
    within: bool
    hot: int = 4000
    block: int = 1 << 21
    chunk: int = 1 << 20


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 mod 2^64, remembered and doubled as needed."""
    have = _powers.get(base, np.ones(1, U))
    while len(have) < n:
        have = np.concatenate([have, have * U(pow(base, len(have), 2**64))])
    _powers[base] = have
    return have[:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(_BASE, len(values)), out=out[1:])
    return out


def pieces(texts: list[np.ndarray], lay: Layout) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Groups of (row, offset, symbols) of at most lay.block symbols; longer texts are cut with overlap, losing no window."""
    group, size = [], 0
    for row, t in enumerate(texts):
        step = lay.block - lay.window
        for at in range(0, max(1, len(t) - lay.window + 1), step):
            part = t[at : at + lay.block - 1]
            if len(part) < lay.window:
                continue
            if size + len(part) > lay.block and group:
                yield group
                group, size = [], 0
            group.append((row, at, part))
            size += len(part)
    if group:
        yield group


def runs(group: list[tuple[int, int, np.ndarray]], lay: Layout) -> tuple[np.ndarray, ...]:
    """(row, lo, hi, h, ctx, more) of the anchors' runs of windows; lo and hi are first and last window start in the text, ctx and more two hashes of all of a run."""
    w = lay.window - lay.gram + 1
    values = np.concatenate([p for _, _, p in group])
    n = len(values)
    sums = prefix_sums(values)
    inv = powers(_INVERSE, n)
    g = mix((sums[lay.gram :] - sums[: -lay.gram]) * inv[: n - lay.gram + 1])
    m = (g & ~_INDEX) | np.arange(len(g), dtype=U)
    span = 1
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < w:
        m = np.minimum(m[: len(m) - (w - span)], m[w - span :])
    lengths = np.array([len(p) for _, _, p in group])
    ends = np.cumsum(lengths)
    first = ends - lengths
    counts = lengths - lay.window + 1
    s = np.arange(counts.sum()) + np.repeat(first - (np.cumsum(counts) - counts), counts)
    a = (m[s] & _INDEX).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    lo, hi, at = s[new], s[np.concatenate([new[1:] - 1, [len(s) - 1]])], a[new]
    ctx = mix((sums[hi + lay.window] - sums[lo]) * inv[lo] + (at - lo).astype(U) * U(0x9E3779B97F4A7C15) + (hi - lo).astype(U) * U(0xC2B2AE3D27D4EB4F))
    again = prefix_sums(mix(values + U(1)))
    more = mix((again[hi + lay.window] - again[lo]) * inv[lo])
    piece = np.searchsorted(ends, lo, side="right")
    shift = np.array([at for _, at, _ in group]) - first
    rows = np.array([r for r, _, _ in group])
    return rows[piece], lo + shift[piece], hi + shift[piece], g[at].view(np.int64), ctx.view(np.int64), more.view(np.int64)


def joined(uid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of window starts, those that touch made one."""
    if not len(uid):
        return uid, lo, hi
    order = np.lexsort((hi, lo, uid))
    uid, lo, hi = uid[order], lo[order], hi[order]
    same = uid[1:] == uid[:-1]
    reach = hi.copy()
    # running maximum of hi within a uid: lift each uid above the one before it
    lift = np.cumsum(np.concatenate([[0], ~same])) * (int(hi.max()) + 2)
    reach = np.maximum.accumulate(hi + lift) - lift
    new = np.concatenate([[True], ~same | (lo[1:] > reach[:-1] + 1)])
    at = np.flatnonzero(new)
    return uid[at], lo[at], reach[np.concatenate([at[1:] - 1, [len(uid) - 1]])]


RUN_TYPES = pa.schema([("h", pa.int64()), ("ctx", pa.int64()), ("more", pa.int64()), ("uid", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
MARK_TYPES = pa.schema([("uid", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def record(types: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, np.ndarray) else pa.array(c.astype(f.type.to_pandas_dtype(), copy=False)) for c, f in zip(columns, types, strict=True)], schema=types)


def _runs_of(docs: DataFrame, lay: Layout, symbols: Callable[[], Callable[[bytes], np.ndarray]]) -> DataFrame:
    """Rows (h, ctx, more, uid, lo, hi); a row with null ctx is a range of windows already known to be repeated.

    Of equal runs in a block only the earliest goes on, so a passage that very many documents share reaches the
    shuffle once per block.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = symbols()
        for batch in it:
            ids = np.array(batch.column("uid"), np.int64)
            texts = binary(batch.column("text"))
            for at in range(0, len(texts), 1000):
                for group in pieces([of(t or b"") for t in texts[at : at + 1000]], lay):
                    row, lo, hi, h, ctx, more = runs(group, lay)
                    uid = ids[at + row]
                    order = np.lexsort((lo, uid, more, ctx, h))
                    row, lo, hi, h, ctx, more, uid = (x[order] for x in (row, lo, hi, h, ctx, more, uid))
                    new = np.concatenate([[True], (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1]) | (more[1:] != more[:-1])])
                    first = np.flatnonzero(new)[np.cumsum(new) - 1]
                    again = uid > uid[first]
                    if lay.within:
                        again |= (uid == uid[first]) & (lo > lo[first])
                    keep = ~again
                    yield record(RUN_TYPES, h[keep], ctx[keep], more[keep], uid[keep], lo[keep], hi[keep])
                    if again.any():
                        u, x, y = joined(uid[again], lo[again], hi[again])
                        yield pa.RecordBatch.from_arrays([pa.array(mix(u.view(U)).view(np.int64)), pa.nulls(len(u), pa.int64()), pa.nulls(len(u), pa.int64()), pa.array(u), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32))], schema=RUN_TYPES)

    return docs.mapInArrow(run, "h long, ctx long, more long, uid long, lo int, hi int")


def _classified(found: DataFrame, lay: Layout) -> DataFrame:
    """(h, hot, uid, lo, hi): repeated ranges with null h, and runs to look at with the number of runs under h."""
    by_run = Window.partitionBy("h", "ctx", "more").orderBy("uid", "lo")
    by_h = Window.partitionBy("h")
    first_uid, first_lo = F.first("uid").over(by_run), F.first("lo").over(by_run)
    again = F.col("uid") > first_uid
    if lay.within:
        again = again | ((F.col("uid") == first_uid) & (F.col("lo") > first_lo))
    rows = found.repartition("h").withColumn("again", F.col("ctx").isNull() | again)
    several = (F.min("ctx").over(by_h) != F.max("ctx").over(by_h)) | (F.min("more").over(by_h) != F.max("more").over(by_h))
    if not lay.within:
        several = several & (F.min("uid").over(by_h) != F.max("uid").over(by_h))
    rows = rows.withColumn("several", several).withColumn("n", F.count("*").over(by_h))
    rows = rows.where("again or several")
    return rows.select(F.when(~F.col("again"), F.col("h")).alias("h"), (F.col("n") > lay.hot).alias("hot"), "uid", "lo", "hi")


def _listed(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy("uid").agg(F.collect_list(F.struct(*columns)).alias("parts"))


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, list[np.ndarray]]]:
    """(uid, text, arrays of the listed columns) of each row."""
    parts = batch.column("parts")
    flat = [np.array(f) for f in parts.flatten().flatten()]
    sizes = np.array(parts.value_lengths().fill_null(0))
    ends = np.cumsum(sizes)
    for uid, text, e, n in zip(batch.column("uid").to_pylist(), binary(batch.column("text")), ends, sizes, strict=True):
        yield uid, text or b"", [f[e - n : e] for f in flat]


def _engine_marks(docs: DataFrame, cold: DataFrame, lay: Layout, cut: Callable, engine: Callable) -> DataFrame:
    """Repeated ranges under anchors with several runs: the runs' text is brought together by anchor and given to the engine."""

    def extract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out, size = [], 0
            for uid, text, (h, lo, hi) in _parts(batch):
                for x, a, data in zip(h.tolist(), lo.tolist(), cut(text, lo, hi + lay.window), strict=True):
                    out.append((x, uid, a, data))
                    size += len(data)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["h", "uid", "lo", "data"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["h", "uid", "lo", "data"])

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in it:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "uid", "lo", "data")), strict=True):
                if size >= lay.chunk and row[0] != held[-1][0]:
                    yield record(MARK_TYPES, *joined(*engine(held)))
                    held, size = [], 0
                held.append(row)
                size += len(row[3]) + 1
        if held:
            yield record(MARK_TYPES, *joined(*engine(held)))
        gc.collect()

    text = docs.join(_listed(cold, "h", "lo", "hi"), "uid").select("uid", "text", "parts").mapInArrow(extract, "h long, uid long, lo int, data binary")
    return text.repartition("h").sortWithinPartitions("h").mapInArrow(search, "uid long, lo int, hi int")


def _hot_marks(docs: DataFrame, hot: DataFrame, lay: Layout, symbols: Callable) -> DataFrame:
    """Repeated windows under anchors with very many runs: two hashes of each window, the earliest place by a grouped minimum."""

    def extract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = symbols()
        types = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("uid", pa.int64()), ("lo", pa.int32())])
        for batch in it:
            for uid, text, (lo, hi) in _parts(batch):
                x = of(text)
                a, b = int(lo.min()), int(hi.max()) + lay.window
                s = np.unique(np.concatenate([np.arange(p, q + 1) for p, q in zip(lo, hi, strict=True)])) - a
                keys = []
                for values in (x[a:b], mix(x[a:b] + U(1))):
                    sums = prefix_sums(values)
                    keys.append(mix((sums[s + lay.window] - sums[s]) * powers(_INVERSE, b - a)[s]).view(np.int64))
                yield record(types, *keys, np.full(len(s), uid), s + a)

    each = docs.join(_listed(hot, "lo", "hi"), "uid").select("uid", "text", "parts").mapInArrow(extract, "k1 long, k2 long, uid long, lo int")
    first = each.groupBy("k1", "k2").agg(F.min(F.struct("uid", "lo")).alias("f"), F.count("*").alias("n")).where("n > 1").select("k1", "k2", F.col("f.uid").alias("u"), F.col("f.lo").alias("l"))
    again = F.col("uid") > F.col("u")
    if lay.within:
        again = again | ((F.col("uid") == F.col("u")) & (F.col("lo") > F.col("l")))
    return each.join(first, ["k1", "k2"]).where(again).select("uid", "lo", F.col("lo").alias("hi"))


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, doc_id, text): uid is doc_id where ids are unique and not null; else numbers in the order of (doc_id, text's hash), one for equal rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seen = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1)
    if seen.isEmpty():
        return rows.select(F.col("doc_id").alias("uid"), "doc_id", "text").where("uid is not null")
    rows = rows.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    pairs = rows.select("doc_id", "th").distinct().repartitionByRange(F.col("doc_id").asc_nulls_first(), "th").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "th")
    uids = stored(pairs.select(F.col("doc_id").alias("i_"), F.col("th").alias("t_"), F.monotonically_increasing_id().alias("uid")), "uids")
    return rows.join(uids, F.col("doc_id").eqNullSafe(F.col("i_")) & (F.col("th") == F.col("t_"))).select("uid", "doc_id", "text").where("uid is not null")


def repeated_ranges(docs: DataFrame, lay: Layout, symbols: Callable, cut: Callable, engine: Callable) -> DataFrame:
    """docs (uid, doc_id, text) with parts: the (lo, hi) ranges of window starts that repeat an earlier window, or null.

    symbols() gives a function from a text's bytes to an array of 64-bit symbol hashes; cut(text, lo, hi) the text
    of symbols lo to hi for arrays of both; engine(rows of (h, uid, lo, data)) the repeated (uid, lo, hi).
    """
    spark = docs.sparkSession
    # texts are moved once, to buckets of their uid; the joins below bring only lists of places to them
    docs = bucketed(docs, "uid", "texts")
    release(spark)
    texts = docs.select("uid", "text")
    found = stored(_classified(_runs_of(texts, lay, symbols), lay), "runs")
    release(spark)
    marks = found.where("h is null").select("uid", "lo", "hi")
    cold, hot = (found.where("h is not null").where(x).select("h", "uid", "lo", "hi") for x in ("not hot", "hot"))
    marks = marks.unionByName(_engine_marks(docs, cold, lay, cut, engine))
    if not hot.isEmpty():
        marks = marks.unionByName(_hot_marks(docs, hot, lay, symbols))
    return docs.join(_listed(marks, "lo", "hi"), "uid", "left").select("uid", "doc_id", "text", "parts")


def covered(lo: np.ndarray, hi: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n symbols lie in a window that starts in one of the ranges."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, np.minimum(hi + window, n), -1)
    return np.cumsum(edge[:n]) > 0


def parts_of(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    """(doc_id, text, lo, hi) of each row of repeated_ranges()."""
    ids = batch.column("doc_id").to_pylist()
    for i, (_, text, parts) in zip(ids, _parts(batch), strict=True):
        lo, hi = parts
        yield i, text, lo.astype(np.int64), hi.astype(np.int64)
