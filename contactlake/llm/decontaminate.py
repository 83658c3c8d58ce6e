"""Benchmark decontamination by a prefix-filtered set join. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, lower_ascii, stored

#: What separates words: every ASCII character but digits and lower-case letters.
GAP_RE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), GAP_RE), "")


def _anchors(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """(key, at, size, starts, words, item_id): each item window waits at its rarest word.

    A window is contained only if all its words are, so of its words in order of rarity a prefix of one is enough.
    Rarity is a word's count over all documents, then its order. words: what the windows that wait there span, under two
    windows' length; at: the key's place in it; starts: those of the windows.
    """
    tokens = items.select("item", F.explode("words").alias("word"))
    vocabulary = tokens.select("word").distinct()
    seen = docs.select(F.explode("words").alias("word")).join(vocabulary, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    counts = vocabulary.join(seen, "word", "left").select("word", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    placed = items.select("item", F.posexplode("words").alias("at", "word")).join(counts, "word")
    spread = placed.join(items.select("item", F.size("words").alias("n_item")), "item")
    size = F.least(F.lit(window), F.col("n_item"))
    spread = spread.withColumn("size", size).withColumn("start", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("size") + 1), F.least(F.col("at"), F.col("n_item") - F.col("size")))))
    rarest = spread.groupBy("item", "start", "size").agg(F.min(F.struct("n", "word", "at")).alias("r"))
    held = rarest.groupBy("item", "size", F.col("r.word").alias("key"), F.col("r.at").alias("at")).agg(F.array_sort(F.collect_list("start")).alias("starts"))
    first = F.get("starts", F.lit(0))
    span = F.element_at("starts", -1) - first + F.col("size")
    return held.join(items.select("item", "item_id", "words"), "item").select("key", (F.col("at") - first).alias("at"), "size", F.transform("starts", lambda s: s - first).alias("starts"), F.slice("words", first + 1, span).alias("words"), "item_id")


#: Up to so many key words are looked for by name; beyond, by a slot of their hash, and the join tells them apart.
NAMED_KEYS, SLOTS = 20_000, 1 << 18


def _is_key(anchors: DataFrame):
    """A test of a word column that holds for every key of the anchors. What it keeps on the driver has a fixed bound."""
    keys = [r[0] for r in anchors.select("key").distinct().limit(NAMED_KEYS + 1).collect()]
    if len(keys) <= NAMED_KEYS:
        return lambda w: w.isin(keys or [""])
    slot = lambda w: F.pmod(F.xxhash64(w), F.lit(SLOTS)).cast("int")
    taken = bytearray(b"0" * SLOTS)
    for r in anchors.select(slot(F.col("key"))).distinct().collect():
        taken[r[0]] = ord("1")
    marks = F.split(F.lit(",".join(taken.decode())), ",").cast("array<int>")
    return lambda w: F.get(marks, slot(w)) == 1


def _met(rows: DataFrame, anchors: DataFrame, is_key, reach: int, small: bool) -> DataFrame:
    """(rid, doc_id, n_words, item_id, hits) of windows found at their keys; one row with nulls for a document without a key."""

    def around(w: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: is_key(F.get(w, i)))
        return F.when(F.size(w) > 0, F.transform(places, lambda i: F.struct(F.get(w, i).alias("key"), i.alias("pos"), F.least(i, F.lit(reach - 1)).alias("off"), F.slice(w, F.greatest(i - (reach - 1), F.lit(0)) + 1, 2 * reach - 1).alias("near"))))

    found = rows.select("rid", "doc_id", F.size("words").cast("long").alias("n_words"), F.explode_outer(let(F.col("words"), around)).alias("c"))
    found = found.select("rid", "doc_id", "n_words", "c.key", "c.pos", "c.off", "c.near")
    if small:
        met = found.join(F.broadcast(anchors), "key", "left")
    else:
        # documents without a key don't share one in the shuffle
        apart = F.concat(F.lit(" "), F.pmod(F.xxhash64("rid"), F.lit(4096)).cast("string"))
        met = found.withColumn("key", F.coalesce("key", apart)).join(anchors.hint("merge"), "key", "left")

    def holds(s: Column) -> Column:
        """Positional bound first: the window must lie within the document around the key; then all of it is compared."""
        before = F.col("at") - s
        return (before <= F.col("off")) & (F.col("off") - before + F.col("size") <= F.size("near")) & (F.slice("near", F.col("off") - before + 1, F.col("size")) == F.slice("words", s + 1, F.col("size")))

    starts = F.transform(F.filter("starts", holds), lambda s: (F.col("pos") - F.col("at") + s).cast("long") * (reach + 1) + F.col("size"))  # start and size in one number
    return met.select("rid", "doc_id", "n_words", F.when(F.size(starts) > 0, F.col("item_id")).alias("item_id"), F.when(F.size(starts) > 0, starts).alias("hits"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, hit_percent: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs.

    Words are lower-cased runs of digits, letters and non-ASCII characters. A document word in any occurrence of an
    item's window of `window` words (of a shorter item: all of it) is hit; contaminated: some are, and at least
    hit_percent of all. Each document keeps its words near the benchmark's key words, meets the windows that wait at
    them, and compares whole windows; then its own hits are merged. Windows of up to broadcast_bytes in all, by measure,
    are broadcast; beyond that they and the documents' key words meet in a shuffle.

    Null texts have no words, null item ids are ignored, rows with the same item id are one item. Every row of docs
    gets its own result, repeated and null ids included. Other columns are ignored. An empty table on either side is
    fine.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), item_words(F.col(text_col)).alias("words"))
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.monotonically_increasing_id().alias("item"), F.col(item_col).cast("string").alias("item_id"), item_words(F.col(item_text)).alias("words")).where(F.size("words") > 0)
    items = stored(items, "items")
    anchors = stored(_anchors(rows, items, window), "anchors")
    # text, item and key, and what an array's elements take besides
    size = F.octet_length(F.concat_ws(" ", "words")) + 16 * F.size("words") + 8 * F.size("starts") + F.octet_length("item_id") + F.octet_length("key") + 64
    small = (anchors.agg(F.sum(size)).first()[0] or 0) <= broadcast_bytes
    hits = _met(rows, anchors, _is_key(anchors), window, small)
    by_row = hits.groupBy("rid", "doc_id", "n_words").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.collect_set("item_id")).alias("items"))

    def union_length(h: Column) -> Column:
        start, size = lambda x: F.floor(x / (window + 1)).cast("long"), lambda x: x % (window + 1)
        zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
        step = lambda a, x: F.struct(F.greatest(a["end"], start(x) + size(x)).alias("end"), (a["n"] + F.greatest(F.lit(0).cast("long"), start(x) + size(x) - F.greatest(a["end"], start(x)))).alias("n"))
        return F.aggregate(F.array_sort(h), zero, step, lambda a: a["n"])

    n_hit = union_length(F.col("hits"))
    out = by_row.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= hit_percent * F.col("n_words")))
