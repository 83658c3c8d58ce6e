"""Key-value settings with defaults, typed parsing and bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def effective(settings: DataFrame) -> DataFrame:
    """One row of settings; a missing or malformed value falls back to its default, then bounds apply."""
    value = lambda k, kind: F.max(F.when(F.col("key") == k, F.col("value").try_cast(kind)))

    def bounded(k: str, kind: str, default, low, high):
        return F.least(F.lit(high).cast(kind), F.greatest(F.lit(low).cast(kind), F.coalesce(value(k, kind), F.lit(default).cast(kind)))).alias(k)

    return settings.agg(
        bounded("max_pages", "int", 10, 1, 15),
        bounded("request_delay", "double", 1.0, 0.0, 10.0),
        bounded("smtp_timeout", "int", 8, 2, 30),
        bounded("max_candidates", "int", 5, 1, 20),
        F.coalesce(F.max(F.when(F.col("key") == "verify_emails", F.col("value"))), F.lit("false")).isin("1", "true", "yes").alias("verify_emails"),
    )
