"""Search sources: anything that tells results for queries as a table can take part in discovery."""

from __future__ import annotations

from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULTS = ["query_id", "pos", "title", "url"]


class SearchSource(Protocol):
    """name, and results(queries): (query_id, pos, title, url) for queries (query_id, q); pos orders the results of a query."""

    name: str

    def results(self, queries: DataFrame) -> DataFrame: ...


class StoredResults:
    """Results that were fetched before: a table of (q, pos, title, url), matched by the query's text without its outer blanks and case."""

    def __init__(self, name: str, stored: DataFrame):
        self.name, self.stored = name, stored

    def results(self, queries: DataFrame) -> DataFrame:
        key = F.lower(F.trim("q"))
        told = self.stored.withColumn("_k", key).drop("q")
        return queries.withColumn("_k", key).join(told, "_k").select(*RESULTS)


class KnownSites:
    """A table of (name, website) whose names hold all of a query's words; pos by name."""

    def __init__(self, name: str, sites: DataFrame):
        self.name, self.sites = name, sites

    def results(self, queries: DataFrame) -> DataFrame:
        """Rows meet at each of the query's words; those that meet at all of them count."""
        words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
        asked = queries.withColumn("w", words("q")).withColumn("n", F.size("w")).select("query_id", "n", F.explode("w").alias("word"))
        held = self.sites.select("name", "website", F.explode(words("name")).alias("word"))
        met = asked.join(held, "word").groupBy("query_id", "n", "name", "website").agg(F.count("*").alias("k")).where("k = n")
        return met.select("query_id", F.abs(F.hash("name")).alias("pos"), F.col("name").alias("title"), F.col("website").alias("url"))


def searched(sources: list[SearchSource], queries: DataFrame) -> DataFrame:
    """(ord, title, url) of all sources' results: by source, query and position, as discovery takes them. A url that several tell comes
    with each; discovery keeps the first of a domain. Rows without a url are left out."""
    if not sources:
        raise ValueError("no search source")
    names = [x.name for x in sources]
    if len({*names}) < len(names):
        raise ValueError("two search sources of one name")
    rows = [x.results(queries).select(*RESULTS).where("url is not null").withColumn("source", F.lit(i)) for i, x in enumerate(sources)]
    return reduce(DataFrame.unionByName, rows).select(F.struct("source", "query_id", "pos", "url").alias("ord"), "title", "url")
