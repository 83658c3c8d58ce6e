"""All queries of the warehouse, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import compositions, crawl, pagequeries, relational, resolution, scalar, sqlsurface, streams  # noqa: F401
from .registry import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export of every visible contact."""
    return QUERIES["union_contacts_export"](spark, sf_dir)


__all__ = ["ORACLES", "QUERIES", "flagship"]
