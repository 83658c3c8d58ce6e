"""The opN_ queries over whole tables, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import cluster_vectors
from .common import spread, table
from .ctw import score_texts
from .decontaminate import contamination
from .divergence import source_divergence
from .licenses import scan_licenses
from .minhash import MinHash, near_duplicates
from .mixing import mix_sources
from .neighbours import nearest_neighbours
from .oracles import ORACLES
from .phrases import remove_repeated_phrases
from .quality import quality_verdicts
from .sharding import assign_shards, grown_tree, hash_tree
from .suffixes import remove_repeated_bytes
from .url_filters import judge_urls


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = hash_tree(8)
    return assign_shards(table(spark, sf_dir, "documents"), tree, grown_tree(tree, 8))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), MinHash(shingle=2))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(documents(spark, sf_dir))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(documents(spark, sf_dir))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_phrases(documents(spark, sf_dir))


def op9_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source, language, a folder for each hundred ids."""
    docs = documents(spark, sf_dir)
    folder = F.concat(F.lit("d"), F.floor(F.col("doc_id") / 100).cast("string"))
    return docs.select("doc_id", F.concat_ws("/", "source", "lang", folder, F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(document_files(spark, sf_dir))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spread(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(spread(table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_licenses": op2_licenses,
    "op3_minhash": op3_minhash,
    "op4_quality": op4_quality,
    "op9_ctw": op9_ctw,
    "op10_url_filters": op10_url_filters,
    "op5_suffix_array": op5_suffix_array,
    "op8_substrings": op8_substrings,
    "op6_decontaminate": op6_decontaminate,
    "op7_sharding": op7_sharding,
    "op11_divergence": op11_divergence,
    "op12_neighbours": op12_neighbours,
    "op13_centroids": op13_centroids,
}

__all__ = ["ORACLES", "QUERIES"]
