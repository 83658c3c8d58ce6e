"""Context-tree weighting over bytes: Krichevsky-Trofimov estimates of binary-decomposed contexts, mixed over all depths."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, discard, release, stored
from .shingles import WordHashes, binary

#: Context bytes; with the byte to come they fill 48 bits of a key, the latest context byte on top.
DEPTH = 5
END = b"\xff"  # never a byte of UTF-8
STEP = 1 << 20
U = np.uint64
_SMALL = np.array([math.lgamma(max(i, 1) / 2) for i in range(4001)])


def log_gamma(x2: np.ndarray) -> np.ndarray:
    """ln Gamma(x2 / 2) of positive integers."""
    x = np.maximum(x2, 4000) / 2.0
    far = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(x2 <= 4000, _SMALL[np.minimum(x2, 4000)], far)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the KT probability of any sequence of a zeros and b ones."""
    return log_gamma(2 * a + 1) + log_gamma(2 * b + 1) - log_gamma(2 * (a + b) + 2) - math.log(math.pi)


def grams(text: bytes) -> np.ndarray:
    """A key for each byte of text and its end mark: the DEPTH bytes before it (0 before the start), then itself."""
    raw = np.frombuffer(b"\0" * DEPTH + text + END, np.uint8)
    n = len(raw) - DEPTH
    out = np.zeros(n, np.int64)
    for i in range(DEPTH):
        out |= raw[DEPTH - 1 - i : DEPTH - 1 - i + n].astype(np.int64) << (8 * (DEPTH - i))
    return out | raw[DEPTH:]


def gram_blocks(text: bytes) -> Iterator[np.ndarray]:
    """grams() of a text a step at a time."""
    if len(text) <= STEP:
        yield grams(text)
        return
    for at in range(0, len(text), STEP):
        head = text[max(0, at - DEPTH) : at]
        g = grams(head + text[at : at + STEP])[len(head) :]
        if not at:
            yield g[:-1]
        else:
            yield g if at + STEP >= len(text) else g[:-1]


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


class Level:
    """The nodes of one depth: sorted keys (context << 8 | byte) with counts, and per bit the nodes and where each key's node is."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys, self.n = keys, n
        self.node, self.at, self.kt, self.zeros, self.ones = [], [], [], [], []
        for j in range(8):
            ids = keys >> (8 - j)
            new = np.concatenate([[True], ids[1:] != ids[:-1]])
            at = np.cumsum(new) - 1
            one = (keys >> (7 - j)) & 1
            total = np.bincount(at, n)
            ones = np.bincount(at, n * one)
            a, b = np.rint(total - ones).astype(np.int64), np.rint(ones).astype(np.int64)
            self.node.append(ids[new]), self.at.append(at), self.zeros.append(a), self.ones.append(b), self.kt.append(log_kt(a, b))

    def above(self) -> tuple[Level, np.ndarray]:
        """The level of contexts one byte shorter, and where there each key's is."""
        short = ((self.keys >> 16) << 8) | (self.keys & 255)
        keys, inverse = np.unique(short, return_inverse=True)
        return Level(keys, np.rint(np.bincount(inverse, self.n)).astype(np.int64)), inverse


def chance(level_zeros, level_ones, at, bit) -> np.ndarray:
    """KT probability of each key's own bit."""
    return (np.where(bit, level_ones[at], level_zeros[at]) + 0.5) / (level_zeros[at] + level_ones[at] + 1.0)


def subtree(keys: np.ndarray, n: np.ndarray, top: int) -> tuple[np.ndarray, Level, list[np.ndarray]]:
    """The tree under one context of length top, from its keys: (q, level, log_w).

    q: for each key and bit the weighted probability of the bit at depth top; level: the nodes there; log_w: their
    ln weighted probability, by bit.
    """
    level = Level(keys, n)
    log_w = [k.copy() for k in level.kt]
    bits = [((keys >> (7 - j)) & 1).astype(bool) for j in range(8)]
    q = np.stack([chance(level.zeros[j], level.ones[j], level.at[j], bits[j]) for j in range(8)], axis=1)
    place = np.arange(len(keys))
    for _ in range(DEPTH - top):
        up, inverse = level.above()
        place = inverse[place]
        for j in range(8):
            # a child's node sits under the node of the shorter context with the same bits
            first = np.flatnonzero(np.concatenate([[True], level.at[j][1:] != level.at[j][:-1]]))
            parent = up.at[j][inverse[first]]
            below = np.bincount(parent, log_w[j], minlength=len(up.node[j]))
            q[:, j] = blended(up.kt[j] - below, up.at[j][place], chance(up.zeros[j], up.ones[j], up.at[j][place], bits[j]), q[:, j])
            log_w[j] = np.logaddexp(up.kt[j], below) - math.log(2)
        level = up
    return q, level, log_w


def blended(log_beta: np.ndarray, at: np.ndarray, own: np.ndarray, deeper: np.ndarray) -> np.ndarray:
    """(beta own + deeper) / (beta + 1), beta the node's odds of stopping over going deeper."""
    stop = 1.0 / (1.0 + np.exp(-np.clip(log_beta, -700, 700)))[at]
    return stop * own + (1.0 - stop) * deeper


def _groups(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, counts) of each two-byte context, from rows sorted by key."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in it:
        keys, n = np.array(batch.column("g"), np.int64), np.array(batch.column("n"), np.int64)
        if not len(keys):
            continue
        cuts = np.flatnonzero((keys[1:] >> 32) != (keys[:-1] >> 32)) + 1
        if held and keys[0] >> 32 != held[-1][0][-1] >> 32:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held = []
        for a, b in zip(np.concatenate([[0], cuts]).astype(int), cuts, strict=False):
            held.append((keys[a:b], n[a:b]))
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held = []
        last = int(cuts[-1]) if len(cuts) else 0
        held.append((keys[last:], n[last:]))
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _crown(totals: list) -> tuple[np.ndarray, ...]:
    """Depths 0 and 1 from (c1, node, zeros, ones, log_w below) rows: (beta, zeros, ones) of each, by context and node."""
    z1, o1, s1 = (np.zeros((256, 256)) for _ in range(3))
    for c, node, z, o, s in totals:
        z1[c, node], o1[c, node], s1[c, node] = z, o, s
    kt1 = log_kt(z1.astype(np.int64), o1.astype(np.int64))
    w1 = np.logaddexp(kt1, s1) - math.log(2)
    z0, o0 = z1.sum(axis=0), o1.sum(axis=0)
    s0 = w1.sum(axis=0)  # contexts never seen weigh ln 1
    kt0 = log_kt(z0.astype(np.int64), o0.astype(np.int64))
    return kt1 - s1, z1, o1, kt0 - s0, z0, o0


def byte_scores(counts: DataFrame) -> DataFrame:
    """(g, lp): log10 probability of each key's byte after its context, from counts (g, n)."""

    def tops(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([("c", pa.int64()), ("node", pa.int64()), ("z", pa.int64()), ("o", pa.int64()), ("s", pa.float64())])
        for keys, n in _groups(it):
            _, level, log_w = subtree(keys, n, 2)
            node = np.concatenate([(level.node[j] & ((1 << j) - 1)) | (1 << j) for j in range(8)])
            c = np.full(len(node), keys[0] >> 40)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c, node, np.concatenate(level.zeros), np.concatenate(level.ones), np.concatenate(log_w))], schema=types)

    by_context = counts.repartition(F.shiftright("g", 32)).sortWithinPartitions("g")
    sums = by_context.mapInArrow(tops, "c long, node long, z long, o long, s double").groupBy("c", "node").agg(F.sum("z"), F.sum("o"), F.sum("s"))
    crown = _crown(sums.collect())  # 256 * 255 rows at most

    def scores(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beta1, z1, o1, beta0, z0, o0 = crown
        for keys, n in _groups(it):
            q, _, _ = subtree(keys, n, 2)
            c = int(keys[0] >> 40)
            lp = np.zeros(len(keys))
            for j in range(8):
                node = ((keys >> (8 - j)) & ((1 << j) - 1)) | (1 << j)
                bit = ((keys >> (7 - j)) & 1).astype(bool)
                p = blended(beta1[c], node, chance(z1[c], o1[c], node, bit), q[:, j])
                p = blended(beta0, node, chance(z0, o0, node, bit), p)
                lp += np.log10(p)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(lp)], ["g", "lp"])

    return by_context.mapInArrow(scores, "g long, lp double")


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    keys = np.concatenate([k for k, _ in parts])
    n = np.concatenate([c for _, c in parts])
    keys, at = np.unique(keys, return_inverse=True)
    return [(keys, np.rint(np.bincount(at, n)).astype(np.int64))]


def tokens_of(text: bytes, hashes: WordHashes) -> np.ndarray:
    """A negative key for each blank-separated word and the end, by 63 bits of the word's hash; grams are never negative."""
    words = text.split()
    words.append(b"")
    return (hashes.of(words) | U(1 << 63)).view(np.int64)


def _units(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, k, n) from rows sorted by chunk: the keys a chunk's texts hold, with counts over training texts."""
    types = pa.schema([("chunk", pa.int64()), ("k", pa.int64()), ("n", pa.int64())])
    now, parts, hashes = None, [], WordHashes()
    waiting, size = {True: [], False: []}, 0

    def absorb() -> None:
        nonlocal parts, waiting, size
        for train, arrays in waiting.items():
            if arrays:
                keys, n = np.unique(np.concatenate(arrays), return_counts=True)
                parts.append((keys, n if train else np.zeros(len(keys), np.int64)))
        waiting, size = {True: [], False: []}, 0
        if len(parts) > 4:
            parts = _merged(parts)

    def told() -> Iterator[pa.RecordBatch]:
        absorb()
        if parts:
            keys, n = _merged(parts)[0]
            for a in range(0, len(keys), 100_000):
                k = keys[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), now)), pa.array(k), pa.array(n[a : a + 100_000])], schema=types)

    for batch in it:
        for chunk, i, text in zip(batch.column("chunk").to_pylist(), batch.column("doc_id").to_pylist(), binary(batch.column("text")), strict=True):
            if chunk != now:
                if now is not None:
                    yield from told()
                now, parts = chunk, []
            text, train = (text or b"").lower(), not held_out(i)
            for g in (tokens_of(text, hashes), *gram_blocks(text)):
                waiting[train].append(g)
                size += len(g)
            if size > STEP:
                absorb()
    if now is not None:
        yield from told()


class Lookup:
    """Values by 64-bit key, for arrays of keys: keys lie in order of a hash, with the start of each hash's run."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys)).bit_length())
        slot = self.slot(keys)
        order = np.argsort(slot, kind="stable")
        self.keys, self.values = keys[order], values[order]
        self.start = np.zeros((1 << self.bits) + 1, np.int32)
        np.cumsum(np.bincount(slot, minlength=1 << self.bits), out=self.start[1:])

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(U) * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """Every wanted key is there."""
        at = self.start[self.slot(wanted)].astype(np.int64)
        left = np.flatnonzero(self.keys[at] != wanted)
        while len(left):
            at[left] += 1
            left = left[self.keys[at[left]] != wanted[left]]
        return self.values[at]


def _labels(spark, n: int) -> list[int]:
    """n numbers that Spark's hash deals to n different buckets; beyond a few thousand, chunks are so many that chance deals them evenly."""
    if n > 4096:
        return list(range(n))
    dealt = spark.range(64 * n).groupBy(F.pmod(F.hash("id"), F.lit(n))).agg(F.min("id")).collect()
    return sorted(r[1] for r in dealt)


def score_texts(docs: DataFrame, chunk_bytes: int = 24 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    Learns from the texts whose crc32(id as text) mod 5 is not 1; a null id counts as one of them. Texts are taken
    with A-Z lower-cased. base_score: a smoothed unigram over blank-separated words and one end (the empty word
    here); words are told apart by 63 bits of a hash. score: log10 probability of the text's bytes and an end mark under the weighted context tree, whose counts
    come from all training texts; a byte's code length is -log2 of its share.

    Texts are dealt to chunks of about chunk_bytes at random, and moved once. A chunk tells which keys and words it holds, once each;
    counts are summed over chunks, the tree is weighted a two-byte context at a time, and each chunk gets back
    the scores of its own keys. So the model, which grows with the corpus, is never held in one place.

    A two-byte context is one group of the tree, the largest that a task holds: it grows with the corpus, to a few
    hundredths of its distinct six-byte strings.

    A null text is empty: its score is that of the end mark. Repeated rows are each learnt and scored. Other columns
    are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes), min(spark.sparkContext.defaultParallelism, -(-size // (chunk_bytes // 8))))
    labels = _labels(spark, chunks)
    drawn = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(len(labels))).cast("int")
    # a bucket for each chunk, or several chunks in one
    buckets = chunks if chunks <= 4096 else None
    chunk = F.get(F.split(F.lit(",".join(map(str, labels))), ",").cast("array<bigint>"), drawn) if buckets else drawn.cast("long")
    dealt = bucketed(rows.withColumn("chunk", chunk), "chunk", "chunks", buckets)
    release(spark)
    units = stored(dealt.sortWithinPartitions("chunk").mapInArrow(_units, "chunk long, k long, n long"), "units")
    counts = stored(units.where("k >= 0").groupBy(F.col("k").alias("g")).agg(F.sum("n").alias("n")), "counts")
    release(spark)
    scores = byte_scores(counts)
    words = units.where("k < 0").groupBy("k").agg(F.sum("n").alias("c"))
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    below = total + 0.5 * (distinct + 1)
    # a known word's score is kept apart from an unknown one's by its sign: -1 stands for count 0
    values = scores.select(F.col("g").alias("k"), F.col("lp").alias("v")).unionByName(words.select("k", F.when(F.col("c") > 0, F.col("c").cast("double")).otherwise(-1.0).alias("v")))
    values = stored(values, "values")
    discard(counts)
    release(spark)
    told = units.select("chunk", "k").join(values, "k").select("chunk", "k", "v")

    def score(texts: pa.Table, facts: pa.Table) -> pa.Table:
        k, v = (np.array(facts.column(c).combine_chunks()) for c in ("k", "v"))
        word = k < 0
        grams_of, c = Lookup(k[~word], v[~word]), v[word]
        words_of = Lookup(k[word], np.where(c > 0, np.log10((np.maximum(c, 0) + 0.5) / below), -math.inf))
        unknown = math.log10(0.5 / below)
        hashes, out = WordHashes(), []
        del k, v, c, word, facts
        for column in texts.select(["doc_id", "text"]).to_batches(max_chunksize=200):
            for i, text in zip(column.column("doc_id").to_pylist(), binary(column.column("text")), strict=True):
                text = (text or b"").lower()
                base = words_of(tokens_of(text, hashes))
                known = np.isfinite(base)
                n = int(known.sum())
                s = sum(float(grams_of(x).sum()) for x in gram_blocks(text))
                out.append((i, held_out(i), len(base), n, int(total), float(base[known].sum()) + unknown * (len(base) - n), s))
        types = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), types, strict=True)], schema=types) if out else types.empty_table()

    return dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
