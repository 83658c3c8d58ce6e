"""Sharding by a hierarchical weighted hash tree (region, rack, shard), in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A node of the tree; leaves carry a shard number. The weight of an inner node is that of its leaves."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def hash_tree(shards: int, per_rack: int = 2, racks: int = 2) -> Node:
    """Shards in racks of per_rack and regions of racks, filled in order; hash_tree(n + 1) adds one leaf to hash_tree(n)."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    size, regions = per_rack * racks, []
    for g in range(0, shards, size):
        of_region = range(g, min(g + size, shards), per_rack)
        regions.append(Node(f"g{g}", tuple(Node(f"g{g}/r{r}", tuple(Node(f"g{g}/r{r}/s{i}", shard=i) for i in range(r, min(r + per_rack, g + size, shards)))) for r in of_region)))
    return Node("root", tuple(regions))


def grown_tree(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region of its own."""
    name = f"g{shard}"
    return Node("root", (*tree.children, Node(name, (Node(f"{name}/r{shard}", (Node(f"{name}/r{shard}/s{shard}", shard=shard, own_weight=weight),)),))))


def _leaf_draw(key: Column, leaf: Node) -> Column:
    """An exponential draw with the shard's weight as its rate, from 53 bits of a 64-bit hash of key and shard number, as a number in (0, 1)."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(f"s{leaf.shard}")), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.struct((-F.log(u) / F.lit(float(leaf.own_weight))).alias("draw"), F.lit(leaf.shard).alias("shard"))


def _entered(key: Column, node: Node) -> Column:
    """(draw, shard) of the shard that a descent from node ends in."""
    if node.shard is not None:
        return _leaf_draw(key, node)
    below = [_entered(key, c) for c in node.children if c.weight > 0]
    if not below:
        raise ValueError(f"no weight under {node.name}")
    return F.least(*below) if len(below) > 1 else below[0]


def shard_of(key: Column, node: Node) -> Column:
    """Descends from node: at each level the child with the smallest draw is entered.

    The draw of a region or rack is the smallest of the draws below it. The smallest of several exponential draws is
    one whose rate is their sum, so each level is a weighted draw by the nodes' weights. A shard's draw depends on key and
    shard alone: where a weight grows, rows move only into that shard, where it falls only out of it, wherever in the tree
    the shard hangs; all other subtrees keep their rows. Equal draws go to the lower number.
    """
    return _entered(key, node)["shard"]


def assign_shards(docs: DataFrame, tree: Node, grown: Node | None = None, id_col: str = "doc_id", text_col: str = "text", slot_buckets: int = 4096) -> DataFrame:
    """Adds size, text_crc32, law, shard, slot and grown_shard to docs' id; law is `key`.

    The shard is decided by the id and the tree alone. slot is gapless from 0 in each shard, by (hash bucket, id,
    crc, size). Rows alike in these are counted first, before any shuffle, and dealt out again at the end, so neither a
    shard's rows nor those of one id and text meet in one task; buckets of a shard are counted, the counts summed up, and
    groups of alike rows numbered within their bucket. A null id is a key like any other (all such rows share a shard);
    a null text has size 1 and crc 0. Columns of docs other than the id and the text are ignored, whatever their names.
    An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    key = F.col("doc_id")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    rows = rows.select("*", shard_of(key, tree).cast("int").alias("shard"), (shard_of(key, grown).cast("int") if grown else F.lit(None).cast("int")).alias("grown_shard"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slot_buckets)).alias("b"))
    counts = rows.groupBy("shard", "b").agg(F.sum("n").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("shard").alias("s_"), F.col("b").alias("b_"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "b").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("i", F.coalesce(F.sum("n").over(within), F.lit(0))).join(starts, (F.col("shard") == F.col("s_")) & (F.col("b") == F.col("b_")))
    out = out.withColumn("slot", F.explode(F.sequence(F.col("start") + F.col("i"), F.col("start") + F.col("i") + F.col("n") - 1)))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
