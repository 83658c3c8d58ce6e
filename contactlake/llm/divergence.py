"""Source divergence audit: how far the word use of a language's sources lies apart.

Count vectors of groups (language, source) are packed by chunks of the vocabulary, replicated to tasks of one group block
by another, and each task sums its pair submatrix over chunk after chunk.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Fixed: shares are told in billionths, each count is raised by 5, a term needs 30 documents.
BILLION = 1_000_000_000
RAISE = 5
LEAST_DOCS = 30

#: Bytes of UTF-8 text that make terms: letters of ASCII, lower-cased, and all beyond ASCII; the rest are blanks.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_PIECE = 1 << 20

_COUNTS = "lang string, source string, term string, docs long, n long"


def _terms(text: bytes) -> Counter:
    """Counts of a text's terms, a megabyte at a time."""
    text, out, at = text.translate(_FOLD), Counter(), 0
    while at < len(text):
        end = text.find(b" ", at + _PIECE)
        end = len(text) if end < 0 else end
        out.update(text[at:end].split())
        at = end
    return out


def _count_batches(batches: Iterator[pa.RecordBatch], most: int = 300_000) -> Iterator[pa.RecordBatch]:
    """Documents and occurrences by group and term, summed within the partition; let go whenever `most` are held."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (docs, n) in held.items():
            terms = list(n)
            columns = [[lang] * (len(terms) + 1), [source] * (len(terms) + 1), [None, *(t.decode() for t in terms)], [0, *(docs[t] for t in terms)], [0, *(n[t] for t in terms)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["lang", "source", "term", "docs", "n"])

    for b in batches:
        langs, sources = (b.column(k).to_pylist() for k in (0, 1))
        for lang, source, text in zip(langs, sources, b.column(2), strict=True):
            docs, n = held.setdefault((lang, source), (Counter(), Counter()))
            found, before = _terms(text.as_py() or b""), len(n)
            n.update(found)
            docs.update(found.keys())
            size += len(n) - before + (not before)
            if size > most:
                yield from out()
                held.clear()
                size = 0
    yield from out()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, docs, n): documents with the term and occurrences; term null, with zeros, for every group."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(_count_batches, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(BILLION * (count + RAISE) / (total + RAISE * terms)), in longs: three digits at a time, so nothing overflows below 9e15 occurrences."""
    a, d = count + RAISE, total + RAISE * terms
    q, r = F.lit(0).cast("long"), a
    for _ in range(3):
        q, r = q * 1000 + F.call_function("div", r * 1000, d), (r * 1000) % d
    return q + 1


def _shares(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """share() of numbers."""
    r, q, d = count + RAISE, np.zeros_like(count), total + RAISE * terms
    for _ in range(3):
        q, r = q * 1000 + r * 1000 // d, r * 1000 % d
    return q + 1


class _Tile:
    """The submatrix of one block of groups by another, summed chunk by chunk."""

    def __init__(self, key: tuple):
        self.key, self.lang, self.left, self.right = key, key[0], [], []
        self.of: dict[str, tuple[int, int]] = {}
        self.sums: np.ndarray | None = None
        self.seen, self.terms, self.chunk, self.rows = 0, 0, -1, []

    def add(self, chunk: int, block: int, source: str, total: int, terms: int, width: int, pos, n) -> None:
        if chunk != self.chunk:
            self.flush()
            self.chunk = chunk
        if chunk < 0:  # every group tells its total first
            self.of[source], self.terms = (total, block), terms
        else:
            self.rows.append((source, width, np.asarray(pos), np.asarray(n)))

    def begin(self) -> None:
        if self.sums is None:
            names = sorted(self.of)
            self.left = [s for s in names if self.of[s][1] == self.key[1]]
            self.right = [s for s in names if self.of[s][1] == self.key[2]]
            self.sums = np.zeros((len(self.left), len(self.right)), dtype=np.int64)

    def _dense(self, names: list[str], rows: dict, width: int) -> np.ndarray:
        out = np.zeros((len(names), width), dtype=np.int64)
        for k, s in enumerate(names):
            if s in rows:
                out[k, rows[s][0]] = rows[s][1]
            out[k] = _shares(out[k], self.of[s][0], self.terms)
        return out

    def _differ(self, rows: dict, width: int, times: int = 1) -> None:
        self.begin()
        a = self._dense(self.left, rows, width)
        b = a if self.key[1] == self.key[2] else self._dense(self.right, rows, width)
        for k in range(len(a)):
            self.sums[k] += times * np.abs(b - a[k]).sum(axis=1)

    def flush(self) -> None:
        if self.rows:
            width = self.rows[0][1]
            self.seen += width
            self._differ({s: (pos, n) for s, _, pos, n in self.rows}, width)
            self.rows = []

    def pairs(self) -> pa.RecordBatch:
        self.flush()
        self.begin()
        if self.terms > self.seen:  # terms that none of these groups has: all alike
            self._differ({}, 1, self.terms - self.seen)
        same = self.key[1] == self.key[2]
        rows = [(s, t, int(self.sums[i, j])) for i, s in enumerate(self.left) for j, t in enumerate(self.right) if s != t]
        rows += [] if same else [(t, s, v) for s, t, v in rows]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array([self.lang] * len(rows), pa.string()), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["lang", "source", "item", "value"])


def _tile_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile and chunk become each tile's pairs; one tile's groups and one chunk of theirs are held at a time."""
    tile = None
    for b in batches:
        for lang, left, right, *row in zip(*(b.column(k).to_pylist() for k in range(b.num_columns)), strict=True):
            if tile is None or tile.key != (lang, left, right):
                if tile:
                    yield tile.pairs()
                tile = _Tile((lang, left, right))
            tile.add(*row)
    if tile:
        yield tile.pairs()


def source_divergence(docs: DataFrame, top: int = 50, least_docs: int = LEAST_DOCS, block: int = 128, chunk: int = 4096) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of all pairs of a language's sources, and each source's `top` most typical terms.

    Null lang, source and text count as ''; a group without terms differs from the others by their shares alone; a language
    of one source has no pairs, one without kept terms has distance 0 and no terms. Repeated rows count each. Ties rank by the item's bytes.
    Other columns are ignored, whatever their names. An empty table gives an empty result.

    Nothing larger than a task's block of groups by a chunk of terms is held; results of pairs are as many as the
    contract's pairs of sources of one language. block: about so many groups a block; chunk: terms a chunk.
    """
    counts = stored(term_counts(docs), "terms")
    groups = counts.where("term is null").select("lang", "source")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_docs).drop("docs")
    kept = stored(kept, "vocabulary")
    langs = groups.groupBy("lang").agg(F.count("*").alias("groups"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    langs = langs.join(sizes, "lang", "left").na.fill(0, ["terms", "lang_total"])
    langs = langs.withColumn("blocks", F.ceil(F.col("groups") / F.lit(block)).cast("int")).withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("terms") / F.lit(chunk))).cast("int"))
    langs = stored(langs.drop("groups"), "langs")

    # vocabulary: a chunk by the term's hash, a place in it
    placed = kept.join(langs, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks").cast("long")).cast("int"))
    place = Window.partitionBy("lang", "chunk")
    placed = placed.withColumn("pos", F.row_number().over(place.orderBy("term")) - 1).withColumn("width", F.count("*").over(place).cast("int"))
    placed = placed.select("lang", "term", "chunk", "pos", "width", "lang_n", "lang_total", "terms")
    used = stored(counts.where("term is not null").select("lang", "source", "term", "n").join(placed, ["lang", "term"]), "used")
    totals = groups.join(used.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").na.fill(0, ["total"])
    totals = totals.join(langs.select("lang", "terms", "lang_total", "blocks"), "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks").cast("long")).cast("int"))
    totals = stored(totals, "totals")

    # packed vectors, to every tile of their block
    packed = used.groupBy("lang", "source", "chunk").agg(F.first("width").alias("width"), F.collect_list(F.struct("pos", "n")).alias("x"))
    packed = packed.join(totals, ["lang", "source"]).select("lang", "chunk", "block", "blocks", "source", "total", "terms", "width", F.col("x.pos").alias("pos"), F.col("x.n").alias("n"))
    heads = totals.select("lang", F.lit(-1).alias("chunk"), "block", "blocks", "source", "total", "terms", F.lit(0).alias("width"), F.lit(None).cast("array<int>").alias("pos"), F.lit(None).cast("array<long>").alias("n"))
    tiles = heads.unionByName(packed).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("lang", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "chunk", "block", "source", "total", "terms", "width", "pos", "n")
    tiles = tiles.repartition("lang", "left", "right").sortWithinPartitions("lang", "left", "right", "chunk", "source")
    pairs = tiles.mapInArrow(_tile_pairs, "lang string, source string, item string, value long")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    own = used.join(totals.select("lang", "source", "total"), ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    typical = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).where(F.col("value") > 0)
    typical = typical.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(typical)
