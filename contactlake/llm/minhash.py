"""MinHash near-duplicate groups: universal hash minima, bands, checked signatures, full-set links, components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, release, stored
from .graph import connected_components
from .shingles import WordHashes, batches, binary, mix, shingle_set


#: Blocks of texts that a member's list of partners spans at most.
PART = 16


@dataclass(frozen=True)
class MinHash:
    """shingle: words in a shingle. A pair links at num * union <= den * intersection, so num/den is the similarity.

    40 bands of 5 minima miss a pair of similarity 0.8 with odds of 1.3e-7. A pair goes on to the full sets if its
    signatures agree in at least `screen` of 200 places, six deviations below 0.8. Buckets are screened in blocks of
    `block` members, texts confirmed in blocks of about `confirm`, fewer if their sets take more than `confirm_bytes`.
    Copies of one set are dealt over `salts` keys.
    """

    shingle: int = 5
    num: int = 80
    den: int = 100
    bands: int = 40
    rows: int = 5
    screen: float = 0.63
    seed: int = 1
    block: int = 1024
    confirm: int = 2048
    confirm_bytes: int = 64 << 20
    salts: int = 64

    def coefficients(self) -> tuple[np.ndarray, np.ndarray]:
        r = np.random.default_rng(self.seed)
        a, b = (r.integers(1, 2**63, self.bands * self.rows, dtype=np.uint64) for _ in range(2))
        return (a << np.uint64(1)) | np.uint64(1), b


def _minima(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of (a x + b) mod 2^64, its upper 32 bits, over 32-bit x, for each of many (a, b)."""
    out = np.full(len(a), 2**32 - 1, np.uint64)
    x = x >> np.uint64(32)
    for i in range(0, len(x), 2048):
        h = a[:, None] * x[None, i : i + 2048]
        h += b[:, None]
        np.minimum(out, h.min(axis=1) >> np.uint64(32), out=out)
    return out


def similar(s: np.ndarray, t: np.ndarray, p: MinHash) -> bool:
    """Whether two shingle sets link; empty ones never do."""
    if min(len(s), len(t)) * p.den < max(len(s), len(t)) * p.num:
        return False
    both = len(np.intersect1d(s, t, assume_unique=True))
    return p.den * both >= p.num * (len(s) + len(t) - both) > 0


def similar_all(s: np.ndarray, others: list[np.ndarray], p: MinHash) -> np.ndarray:
    """similar() of one set with each of several, none of them empty."""
    if not len(s):
        return np.zeros(len(others), bool)
    sizes = np.array([len(t) for t in others])
    joined = np.concatenate(others)
    at = np.searchsorted(s, joined)
    at[at == len(s)] = 0
    both = np.add.reduceat(s[at] == joined, np.cumsum(sizes) - sizes, dtype=np.int64)
    return p.den * both >= p.num * (len(s) + sizes - both)


def sketches(docs: DataFrame, p: MinHash, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, fp, bands, sig) of every row: set size, digest of the set, band keys, 16 bits of each minimum."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (a, b) = WordHashes(), p.coefficients()
        salt = mix(np.arange(1, p.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for ids, texts in batches(it, ["id", "text"]):
            n, fp, bands, sig = [], [], [], []
            known: dict[bytes, tuple] = {}
            for t in texts:
                s = shingle_set(t, p.shingle, hashes)
                n.append(len(s))
                if not len(s):
                    fp.append(None), bands.append([]), sig.append(None)
                    continue
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if digest not in known:
                    m = _minima(s, a, b)
                    key = salt.copy()
                    for col in m.reshape(p.bands, p.rows).T:
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + col)
                    known[digest] = key.view(np.int64), m.astype(np.uint16).tobytes()
                fp.append(digest), bands.append(known[digest][0]), sig.append(known[digest][1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())], ["id", "n", "fp", "bands", "sig"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n long, fp binary, bands array<long>, sig binary")


def _screened(pairs: DataFrame, sigs: DataFrame, p: MinHash) -> DataFrame:
    """(a, b, est) of the pairs whose set sizes allow the similarity and whose signatures agree often enough."""
    side = lambda c: sigs.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}"))
    met = pairs.join(side("b"), "b").join(side("a"), "a").where(F.least("na", "nb") * p.den >= F.greatest("na", "nb") * p.num)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
                est = (x == y).mean(axis=1)
                keep = pa.array(est >= p.screen)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(est[est >= p.screen])], ["a", "b", "est"])

    return met.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, est double").distinct()


def _linked(pairs: DataFrame, texts: DataFrame, p: MinHash) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last = WordHashes(), (None, None)
        for a, b, ta, tb in batches(it, ["a", "b", "ta", "tb"]):
            out = []
            for i, j, s, t in zip(a, b, ta, tb, strict=True):
                if last[0] != s:
                    last = s, shingle_set(s, p.shingle, hashes)
                y = shingle_set(t, p.shingle, hashes)
                if similar(last[1], y, p):
                    out.append((i, j))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    side = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"t{c}"))
    return pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def _leftover_links(members: DataFrame, sigs: DataFrame, texts: DataFrame, p: MinHash) -> DataFrame:
    """(a, b) links between different components in buckets that hold several: every such pair is looked at.

    members: (key, id, comp, m) with m the bucket's size. A bucket of more than `block` members is dealt to blocks; a
    task screens two blocks' signatures at a time, so it holds 2 * block of them whatever the bucket's size. Screened
    pairs go on as one list per member and part of its partners, and are confirmed on full sets two blocks of texts at a
    time, skipping what the links found there already join. So neither rows nor memory grow with pairs.
    """
    k = F.ceil(F.col("m") / p.block)
    own = F.pmod(F.xxhash64("id"), k)
    dealt = members.withColumn("k", k).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    ids = stored(members.select("id").distinct().join(sigs.groupBy("id").agg(F.sum("n").alias("n")), "id"), "ids")
    size = ids.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = max(1, -(-size[0] // p.confirm), -(-8 * size[1] // p.confirm_bytes))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "comp", block("id").alias("block")).join(sigs.select("id", "n", "sig"), "id")
    listed = pa.schema([("id", pa.int64()), ("part", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def screen(rows: list[tuple]) -> Iterator[tuple]:
        i, j = rows[0][1], rows[0][2]
        own, ids, comp, n, part = (np.array([r[x] for r in rows], np.int64) for x in (3, 4, 5, 6, 8))
        sig = np.frombuffer(b"".join(r[7] for r in rows), np.uint16).reshape(len(rows), -1)
        part //= PART
        for x in range(len(rows)):
            # within a block each pair once, between two blocks only across
            ok = (np.arange(len(rows)) > x) & (comp != comp[x]) & (ids != ids[x]) & (np.minimum(n, n[x]) * p.den >= np.maximum(n, n[x]) * p.num)
            if i != j:
                ok &= own != own[x]
            at = np.flatnonzero(ok)
            if len(at):
                at = at[(sig[at] == sig[x]).mean(axis=1) >= p.screen]
                for y in np.unique(part[at]):
                    yield (int(ids[x]), int(y)), ids[at[part[at] == y]]

    def grouped(it: Iterator[pa.RecordBatch], columns: tuple[str, ...], width: int) -> Iterator[list[tuple]]:
        group: list[tuple] = []
        for batch in it:
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if group and group[0][:width] != row[:width]:
                    yield group
                    group = []
                group.append(row)
        if group:
            yield group

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a task's buckets say about a member goes on as one list."""
        met: dict[tuple[int, int], list[np.ndarray]] = {}
        size = 0

        def told() -> pa.RecordBatch:
            keys = list(met)
            lists = [np.unique(np.concatenate(met[k])) for k in keys]
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(lists, pa.list_(pa.int64()))], schema=listed)

        for group in grouped(it, ("key", "i", "j", "own", "id", "comp", "n", "sig", "block"), 3):
            for key, partners in screen(group):
                met.setdefault(key, []).append(partners)
                size += len(partners)
            if size > 2_000_000:
                yield told()
                met, size = {}, 0
        if met:
            yield told()

    def confirm(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, now, sets, top = WordHashes(), None, {}, {}

        def root(v: int) -> int:
            while top.setdefault(v, v) != v:
                top[v] = v = top[top[v]]
            return v

        for batch in it:
            out = []
            for x, y, i, others, text in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "id", "ids")), binary(batch.column("text")), strict=True):
                if (x, y) != now:
                    now, sets, top = (x, y), {}, {}
                if others is None:
                    sets.setdefault(i, []).append(shingle_set(text, p.shingle, hashes))
                    continue
                for at in range(0, len(others), 256):
                    apart = [o for o in others[at : at + 256] if root(o) != root(i)]
                    texts = [(o, t) for o in apart for t in sets.get(o, ()) if len(t)]
                    for s in sets.get(i, ()) if texts else ():
                        for (o, _), ok in zip(texts, similar_all(s, [t for _, t in texts], p), strict=True):
                            if ok and root(i) != root(o):
                                top[root(i)] = root(o)
                                out.append((i, o))
            yield pa.RecordBatch.from_arrays([pa.array([v[c] for v in out], pa.int64()) for c in (0, 1)], ["a", "b"])

    ranked = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "own", "id", "comp", "n", "sig", "block")
    lists = ranked.mapInArrow(run, "id long, part long, ids array<long>").groupBy("id", "part").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    other = F.explode(F.sequence(F.col("part") * PART, F.least(F.col("part") * PART + PART - 1, F.lit(blocks - 1)).cast("long")))
    lists = lists.withColumn("other", other).select("id", "other", F.filter("ids", lambda v: block(v) == F.col("other")).alias("ids")).where(F.size("ids") > 0)
    lists = stored(lists.select(F.least(block("id"), "other").alias("x"), F.greatest(block("id"), "other").alias("y"), "id", "ids"), "lists")
    tasks = lists.select("x", "y").distinct()
    sides = tasks.select("x", "y", F.col("x").alias("block")).unionByName(tasks.where("x <> y").select("x", "y", F.col("y").alias("block")))
    held = texts.join(ids, "id", "left_semi").withColumn("block", block("id")).join(sides, "block").select("x", "y", "id", F.lit(None).cast("array<long>").alias("ids"), "text")
    both = held.unionByName(lists.withColumn("text", F.lit(None).cast("string")))
    # texts first: their list is null
    return both.repartition("x", "y").sortWithinPartitions("x", "y", F.col("ids").isNotNull()).mapInArrow(confirm, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, p: MinHash | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    1. Rows with the same shingle set form a class, whose smallest id stands for it (hot groups of copies end here,
       by a grouped minimum).
    2. Representatives that share a band meet in a bucket. Each is paired with the bucket's smallest id, screened by
       signature and confirmed on the full sets: the best partner of each first, then those pairs that still join
       different components.
    3. Buckets that still hold several components are compared in full, block against block, so no link is lost to
       the star form; components follow from all links by alternating large-star and small-star.

    Ids are whole numbers, or texts of such; anything else fails the cast. Nothing is capped. Texts without words (null, empty, blank) have n_shingles 0 and stand alone. Rows with the
    same id are one node, with the links of any of them. Rows with a null id are never linked: component_id is null
    and kept true. Other columns of docs are ignored. An empty table gives an empty result.
    """
    p = p or MinHash()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sk = stored(sketches(rows, p, "id", "text"), "sketch")
    # a class's copies, and rows without a class, are dealt over salts: no task meets all of them
    salt = F.pmod(F.xxhash64("id"), F.lit(p.salts))
    parts = sk.where("n > 0 and id is not null").groupBy("fp", salt.alias("salt")).agg(F.min("id").alias("low"))
    classes = parts.groupBy("fp").agg(F.min("low").alias("rep"))
    told = parts.join(classes, "fp").select("fp", "salt", "rep")
    apart_key = F.coalesce(F.when(F.col("id").isNotNull(), F.col("fp")), F.concat(F.lit("-"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(4096)).cast("string")).cast("binary"))
    member = stored(sk.select("id", "n", apart_key.alias("fp"), salt.alias("salt")).join(told, ["fp", "salt"], "left").select("id", "n", "rep"), "member")
    # an id with several different texts joins their classes
    varied = member.where("rep is not null").groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("id", "lo")
    same_id = member.join(varied, "id").select(F.col("lo").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()

    reps = sk.join(classes, (sk["fp"] == classes["fp"]) & (sk["id"] == classes["rep"]), "left_semi")
    banded = reps.select("id", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("id").alias("c"), F.count("*").alias("m")).where("m > 1")
    met = stored(banded.join(buckets, "key").select("key", "id", "c", "m"), "buckets")
    sigs = reps.select("id", "n", "sig")
    star = met.where("id <> c").select(F.col("c").alias("a"), F.col("id").alias("b")).distinct()
    near = stored(_screened(star, sigs, p), "pairs")
    release(sk.sparkSession)

    ids = met.select("id").distinct()
    texts = stored(rows.join(ids, "id", "left_semi"), "texts")
    release(sk.sparkSession)
    best = near.groupBy("b").agg(F.max(F.struct("est", -F.col("a"))).alias("x")).select((-F.col("x.col2")).alias("a"), "b")
    best = stored(best, "best")
    links = stored(_linked(best, texts, p).unionByName(same_id), "links")

    def apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
        of = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
        return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    comp = connected_components(links, "a", "b")
    rest = apart(near.join(best, ["a", "b"], "left_anti"), comp)
    more = stored(_linked(rest, texts, p), "links")
    if not more.isEmpty():
        links = links.unionByName(more)
        comp = connected_components(links, "a", "b")
    release(sk.sparkSession)

    inside = met.where("m > 2").select("key", "id", "m").join(comp.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "m", F.coalesce("component", "id").alias("comp"))
    split = inside.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    last = stored(_leftover_links(stored(inside.join(split, "key"), "leftover"), sigs, texts, p), "links")
    if not last.isEmpty():
        comp = connected_components(links.unionByName(last), "a", "b")
    for done in (sk, met, near, texts, best, links, more, last):
        discard(done)
    release(sk.sparkSession)
    out = member.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
