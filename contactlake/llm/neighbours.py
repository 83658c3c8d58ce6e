"""Approximate nearest neighbours by a permutation index: each vector is the order in which it sees the pivots.

Vectors are posted in the inverted files of their nearest pivots; a query visits the files of its own nearest pivots, ranks
what is posted there by the footrule distance of the two orders, and compares the vectors themselves as far down the
ranking as the index was fitted to need.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


@dataclass(frozen=True)
class PermutationIndex:
    """sample: vectors that the index is fitted on, at most; posted: files that a vector is in; recall: aimed at in the sample.

    list_block and query_block: postings and queries that one task compares at a time.
    """

    sample: int = 4096
    most_pivots: int = 512
    posted: int = 4
    recall: float = 0.96
    list_block: int = 2048
    query_block: int = 1024


@dataclass(frozen=True)
class _Fitted:
    """pivots: unit vectors; visited: files that a query visits; near: largest footrule distance that is looked at closely."""

    pivots: np.ndarray
    posted: int
    visited: int
    near: int


def usable(vector: Column) -> Column:
    """True for a vector of finite components, not all zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array | list, width: int | None = None) -> np.ndarray:
    """Vectors as rows, the shorter filled up with zeros; cut off at width."""
    rows = [np.asarray(x, dtype=float) for x in column]
    width = max((len(x) for x in rows), default=0) if width is None else width
    out = np.zeros((len(rows), width))
    for k, x in enumerate(rows):
        out[k, : len(x)] = x[:width]
    return out


def _places(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Place of each pivot in each vector's order, by falling inner product, ties to the earlier pivot."""
    order = np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")
    out = np.empty(order.shape, dtype=np.int16)
    np.put_along_axis(out, order, np.arange(order.shape[1], dtype=np.int16)[None, :], 1)
    return out


def _nearest_pivots(places: np.ndarray, k: int) -> np.ndarray:
    return np.argsort(places, axis=1, kind="stable")[:, :k].astype(np.int16)


def _footrule(places: np.ndarray, place: np.ndarray) -> np.ndarray:
    return np.abs(places - place[None, :]).sum(axis=1, dtype=np.int64)


def fitted(sample: np.ndarray, rows: int, k: int, index: PermutationIndex) -> _Fitted:
    """Pivots from the sample, about the root of the rows; files to visit and the footrule distance to look into, the cheapest that find the sample's own k nearest of up to 256 of its vectors in a share `recall`."""
    count = min(len(sample), index.most_pivots, max(64, int(np.ceil(rows**0.5))))
    scale = np.abs(sample[:count]).max(axis=1, keepdims=True)  # first, lest squares overflow
    pivots = sample[:count] / scale
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    places, posted = _places(sample, pivots), min(index.posted, count)
    files = _nearest_pivots(places, posted)
    tries = range(len(sample))[-256:]
    feet, true = [], []
    for t in tries:
        score = sample @ sample[t]
        score[t] = -np.inf
        true.append(np.argsort(-score, kind="stable")[: min(k, len(sample) - 1)])
        feet.append(_footrule(places, places[t]))
    best = None
    for visited in sorted({max(1, count // n) for n in (32, 16, 8, 4, 2, 1)}):
        seen = [(places[t][files] < visited).any(axis=1) for t in tries]
        found = np.concatenate([np.where(s[x], f[x], np.iinfo(np.int64).max) for s, f, x in zip(seen, feet, true, strict=True)] or [np.zeros(0)])
        if not len(found):
            break
        near = np.sort(found)[max(0, int(np.ceil(index.recall * len(found))) - 1)]
        if near == np.iinfo(np.int64).max:
            continue
        share, close = np.mean([s.mean() for s in seen]), np.mean([(s & (f <= near)).mean() for s, f in zip(seen, feet, strict=True)])
        cost = share * count + close * 8 * sample.shape[1]  # a comparison of vectors gathers and multiplies
        if best is None or cost < best[0]:
            best = (cost, visited, int(near))
    return _Fitted(pivots, posted, *(best[1:] if best else (count, np.iinfo(np.int64).max)))


def _scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed component by component from the first on, so that equal vectors have equal scores anywhere."""
    out = np.zeros(len(vectors))
    for j in range(min(vectors.shape[1], len(query))):
        out += vectors[:, j] * query[j]
    return out


def _best(cids: np.ndarray, firsts: np.ndarray, vectors: np.ndarray, at: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of the vectors at `at`, ties to the smaller first id: their classes and scores."""
    some = vectors[at]
    if len(at) > 2 * k:  # a fast product first, to within its rounding
        rough = some @ query[: some.shape[1]]
        slack = 1e-10 * float(np.abs(some).max() * np.abs(query).max() * len(query))
        with np.errstate(invalid="ignore"):
            keep = ~(rough < np.partition(rough, -k)[-k] - slack)
        at, some = at[keep], some[keep]
    score = _scores(some, query)
    o = np.lexsort((firsts[at], -score))[:k]
    return cids[at[o]], score[o]


_FOUND = "qcid long, cid long, first long, score double"
_FOUND_ARROW = pa.schema([("qcid", pa.int64()), ("cid", pa.int64()), ("first", pa.int64()), ("score", pa.float64())])


def _compare(k: int, fit: _Fitted | None):
    """A file's block against a block of queries; without fit all pairs are compared."""

    def compare(key: tuple, posted: pa.Table, asking: pa.Table) -> pa.Table:
        if not posted.num_rows or not asking.num_rows:
            return _FOUND_ARROW.empty_table()
        pivot = key[0].as_py()
        cids, firsts = (posted.column(c).to_numpy() for c in ("cid", "first"))
        vectors = _matrix(posted.column("v").to_numpy())
        queries = asking.column("v").to_numpy()
        if fit:
            places, theirs = (np.frombuffer(b"".join(t.column("places").to_pylist()), dtype=np.int16).reshape(t.num_rows, -1) for t in (posted, asking))
            files = _nearest_pivots(places, fit.posted)
            ahead = np.cumsum(files == pivot, axis=1) == 0  # files of the vector that come before this one
        out = []
        for i, (qcid, q) in enumerate(zip(asking.column("qcid").to_pylist(), queries, strict=True)):
            at = np.arange(len(cids))
            if fit:
                # a pair that shares several files is compared in the vector's first
                at = at[~((theirs[i][files] < fit.visited) & ahead).any(axis=1)]
                if len(at) > k:
                    feet = _footrule(places[at], theirs[i])
                    at = at[feet <= max(fit.near, int(np.partition(feet, k - 1)[k - 1]))]
            if len(at):
                best, score = _best(cids, firsts, vectors, at, np.asarray(q, dtype=float), k)
                out.append((np.full(len(best), qcid), best, score))
        if not out:
            return _FOUND_ARROW.empty_table()
        qcid, cid, score = (np.concatenate(x) for x in zip(*out, strict=True))
        first = firsts[np.argsort(cids)][np.searchsorted(np.sort(cids), cid)]
        return pa.table([qcid, cid, first, score], schema=_FOUND_ARROW)

    return compare


def _of(counts: list[int], pivot: str, block: int) -> Column:
    """Blocks of the pivot's file, by its size."""
    return F.element_at(F.array(*[F.lit(max(1, -(-n // block))) for n in counts]), F.col(pivot) + 1)


def _block(cid: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(cid), blocks.cast("long")).cast("int")


def _met(posted: DataFrame, asking: DataFrame, sizes: list[int], asked: list[int], k: int, fit: _Fitted | None, index: PermutationIndex) -> DataFrame:
    """(qcid, cid, first, score): the k best of each block of a file for each query that visits it. pivot: the file."""
    nb, nq = _of(sizes, "pivot", index.list_block), _of(asked, "pivot", index.query_block)
    left = posted.withColumn("pb", _block("cid", nb)).withColumn("qb", F.explode(F.sequence(F.lit(0), nq - 1)))
    right = asking.withColumn("qb", _block("qcid", nq)).withColumn("pb", F.explode(F.sequence(F.lit(0), nb - 1)))
    keys = ["pivot", "pb", "qb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_compare(k, fit), _FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qcid").orderBy(F.col("score").desc(), "first")
    return found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def nearest_neighbours(vectors: DataFrame, query: Column, k: int = 20, index: PermutationIndex = PermutationIndex(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each row that `query` (a condition on vec_id) holds for.

    Candidates are all rows but the query's own; all of them, if they are no more than k. Scores are the inner product in double
    precision, its terms added from the first component on; equal scores rank by smaller vec_id. Rows without an id, and those whose vector is
    null, empty, all zero, or holds null, NaN or infinities take no part. Rows alike in id and vector count once; an id with several vectors
    is as many rows. A shorter vector counts as filled up with zeros. Other columns are ignored, whatever their names. An empty
    table gives an empty result.

    Equal vectors are one class, of which only its k + 1 smallest ids can be among the nearest of any query; the index holds
    classes, so copies cost nothing. Fitting looks at `index.sample` classes, picked by hash, on the driver; every class is posted. Files are
    compared in blocks of bounded size by blocks of queries; only the k + 1 best of a block go on. What is posted grows as the rows, what is compared
    as fit needs it: little where vectors lie in clusters, most where they fill space evenly. A query that met fewer rows than it must return is
    compared with every class.
    """
    need = k + 1  # the query's own row is among them
    clean = F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0))  # no negative zeros
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), clean.alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = stored(rows.distinct(), "vectors")
    few = rows.withColumn("rn", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("rn") <= need)
    classes = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.monotonically_increasing_id().alias("cid"), F.element_at("ids", 1).alias("first"), "ids", "v")
    classes = stored(classes, "classes")
    asking = rows.where(query).join(classes.select("cid", F.col("v").alias("w")), F.col("v") == F.col("w"))
    asking = stored(asking.select(F.col("vec_id").alias("query_id"), F.col("cid").alias("qcid")), "queries")
    asked = asking.select(F.col("qcid").alias("cid")).distinct()

    size = classes.agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("rows")).first()
    sample = classes.select("v").orderBy(F.xxhash64("v"), "v").limit(index.sample).collect()
    fit = fitted(_matrix([r.v for r in sample]), size.n, k, index) if sample else _Fitted(np.zeros((1, 1)), 1, 1, 0)
    width = fit.pivots.shape[1]

    def with_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = _places(_matrix(b.column("v").to_numpy(zero_copy_only=False), width), fit.pivots)
            yield b.append_column("places", pa.array([p.tobytes() for p in places], pa.binary()))

    def with_files(n: int):
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                places = np.frombuffer(b"".join(b.column("places").to_pylist()), dtype=np.int16).reshape(b.num_rows, -1)
                yield b.append_column("files", pa.array(list(_nearest_pivots(places, n).astype(np.int32)), pa.list_(pa.int32())))

        return add

    placed = "cid long, first long, v array<double>, places binary"
    seen = stored(classes.select("cid", "first", "v").mapInArrow(with_places, placed), "places")
    posted = seen.mapInArrow(with_files(fit.posted), f"{placed}, files array<int>").select("cid", "first", "v", "places", F.explode("files").alias("pivot"))
    asks = seen.join(asked, "cid", "left_semi").mapInArrow(with_files(fit.visited), f"{placed}, files array<int>")
    visits = asks.select(F.col("cid").alias("qcid"), "v", "places", F.explode("files").alias("pivot"))

    def counted(files: DataFrame) -> list[int]:
        told = {r.pivot: r.n for r in files.groupBy("pivot").agg(F.count("*").alias("n")).collect()}
        return [told.get(p, 0) for p in range(len(fit.pivots))]

    sizes, visitors = counted(posted), counted(visits)
    found = stored(_top(_met(posted, visits, sizes, visitors, need, fit, index), need), "found")
    met = found.join(classes.select("cid", F.size("ids").alias("n")), "cid").groupBy("qcid").agg(F.sum("n").alias("n"))
    short = asked.join(met.where(F.col("n") >= min(need, size.rows or 0)), F.col("cid") == F.col("qcid"), "left_anti")
    short = stored(classes.join(short, "cid", "left_semi").select(F.col("cid").alias("qcid"), "v", F.lit(0).alias("pivot")), "short")
    if n := short.count():
        every = classes.select("cid", "first", "v", F.lit(0).alias("pivot"))
        more = _met(every, short, [size.n], [n], need, None, index)
        found = stored(_top(found.join(short.select("qcid"), "qcid", "left_anti").unionByName(more), need), "found")

    rows_of = found.join(classes.select("cid", "ids"), "cid").select("qcid", "cid", "score", F.explode("ids").alias("vec_id"))
    best = rows_of.withColumn("rn", F.row_number().over(Window.partitionBy("qcid").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("rn") <= need)
    best = best.groupBy("qcid").agg(F.sort_array(F.collect_list(F.struct("rn", "vec_id", "score", "cid"))).alias("best"))
    of_query = F.slice(F.filter("best", lambda x: (x["vec_id"] != F.col("query_id")) | (x["cid"] != F.col("qcid"))), 1, k)
    out = asking.join(best, "qcid").select("query_id", F.posexplode(of_query).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
