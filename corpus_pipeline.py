"""From raw documents to shards: quality rules, near-dedup, decontamination, mixing, sharding.

Every stage but the last returns rows of its input as they are, with all columns, whatever their names; an empty table
gives an empty one. Rows decide for themselves: null or repeated ids don't matter where a text decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactlake.llm.common import stored, table
from contactlake.llm.decontaminate import contamination
from contactlake.llm.minhash import MinHash, near_duplicates
from contactlake.llm.mixing import Mixing, mixed
from contactlake.llm.quality import passing
from contactlake.llm.sharding import assign_shards, grown_tree, hash_tree


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number of its own for each row, written once, so every later read sees the same one; and the number's column."""
    name = "__row"
    while name in docs.columns:
        name = "_" + name
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def _kept(rows: DataFrame, ids: DataFrame, row: str) -> DataFrame:
    """The numbered rows among ids, without their numbers."""
    return rows.join(ids.select(row), row, "left_semi").drop(row)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; a null or empty text has too few words. Equal rows share their fate."""
    return passing(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates.

    The one with the smallest id stays, null ids last; of rows with equal ids the first as read. Texts without words
    are like no other and all stay.
    """
    rows, row = _numbered(docs)
    near = near_duplicates(rows, MinHash(shingle=5), id_col=row).select(F.col("doc_id").alias(row), "component_id")
    named = near.join(rows.select(row, F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", row).alias("rank")), row)
    return _kept(rows, named.groupBy("component_id").agg(F.min("rank").alias("first")).select(F.col(f"first.{row}").alias(row)), row)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark's passages; a text without words has none."""
    rows, row = _numbered(docs)
    found = contamination(rows, table(spark, sf_dir, "benchmark"), id_col=row)
    return _kept(rows, found.where("not contaminated").select(F.col("doc_id").alias(row)), row)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say.

    Those that most likely are clean stay, once at least, even where that puts the targets out of reach: a stage that
    filters keeps clean documents. Equal rows are drawn alike; a null id or text counts like any
    other value. Labels come from the table `labels`; domains that none of the rows' labels name have no target.
    """
    return mixed(docs, table(spark, sf_dir, "labels"), Mixing(keep="clean"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes, by its id; a row that the mix repeats goes to one shard with each copy a slot of its own."""
    tree = hash_tree(8)
    return assign_shards(docs, tree, grown_tree(tree, 8))


STAGES = [("quality rules", quality), ("near-dedup", dedup), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

#: Hashed features, fitted rates and hash draws have no SQL form; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the table documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = stored(out, f"stage{k}") if k + 1 < len(STAGES) else out
    return docs
