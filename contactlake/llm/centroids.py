"""Centroid clustering: plain Lloyd rounds over integer vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: Components whose 1024-fold fits a long without rounding; integers up to SMALL can be squared and summed in 64 bits.
LARGEST = float(1 << 52)
SMALL = 1 << 27
LONG_MAX = (1 << 63) - 1


def integers(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def usable(vector: Column, components: int) -> Column:
    """True for a vector of exactly that many finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) >= F.lit(LARGEST)))
    return F.coalesce((F.size(vector) == components) & ~odd, F.lit(False))


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and the squared distance to it for each row of x; ties go to the smaller number.

    64-bit integers where they suffice, Python's own beyond.
    """
    large = max(int(np.abs(x).max(initial=0)), max(abs(v) for c in centroids for v in c)) > SMALL
    kind = object if large else np.int64
    x = x.astype(kind)
    d = np.stack([((x - np.array(c, dtype=kind)) ** 2).sum(axis=1) for c in centroids], axis=1)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


def _round_sums(rows: DataFrame, centroids: list[list[int]]) -> list:
    """(cluster, j, total, n): sums of components of each cluster, summed in each partition, then over partitions; clusters x components rows."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = [[0] * len(c) for c in centroids], [0] * len(centroids)
        for b in batches:
            if len(b):
                x = np.stack(b["x"].to_numpy())
                at, _ = nearest(x, centroids)
                kind = np.int64 if np.abs(x).max() <= SMALL else object  # a batch has far fewer than 2^35 rows
                for k in np.unique(at):
                    part = x[at == k]
                    n[k] += len(part)
                    total[k] = [a + int(v) for a, v in zip(total[k], part.astype(kind).sum(axis=0), strict=True)]
        yield pd.DataFrame([(k, j, str(v), n[k]) for k, t in enumerate(total) if n[k] for j, v in enumerate(t)], columns=["cluster", "j", "total", "n"])

    parts = rows.select("x").mapInPandas(sums, "cluster int, j int, total string, n long")
    return parts.groupBy("cluster", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()


def lloyd(rows: DataFrame, centroids: list[list[int]], rounds: int) -> list[list[int]]:
    """Centroids after so many rounds over rows (x array<long>); an empty one stays where it is."""
    for _ in range(rounds):
        moved = [list(c) for c in centroids]
        for r in _round_sums(rows, centroids):
            moved[r.cluster][r.j] = int(r.total) // r.n
        if moved == centroids:  # the rounds left would change nothing
            break
        centroids = moved
    return centroids


def cluster_vectors(vectors: DataFrame, clusters: int = 8, rounds: int = 10, components: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", seed: str = "3") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row for each vector kept.

    Kept are rows whose vector has exactly `components` components, none null, NaN or infinite; components of 2^52 or more
    can't be turned into exact longs, such rows take no part. Centroids start as the `clusters` kept vectors whose id
    comes first by sha256 of `seed:id` (equal hashes, as of repeated ids: by the vector; a null id counts as an empty text); fewer vectors make
    fewer clusters, equal starting vectors leave the later cluster empty. Distances are exact; those, and their sums, that
    exceed a long are null. Other columns are ignored, whatever their names. An empty table gives an empty result.

    A round is one pass: centroids go out with the task, partitions return one row per cluster and component,
    so neither a large cluster nor many copies of a vector meet in one task, and the driver holds clusters x components numbers.
    """
    name = F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    kept = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).where(usable(F.col("v"), components))
    kept = stored(kept.select("vec_id", integers(F.col("v")).alias("x")), "vectors")
    first = kept.select(name.alias("h"), "x").orderBy("h", "x").limit(clusters).collect()
    schema = kept.select("vec_id").schema.add("cluster", "integer").add("d", "string")
    if not first:
        centroids = [[0] * components]  # no row asks for it
    else:
        centroids = lloyd(kept, [list(r.x) for r in first], rounds)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                at, d = nearest(np.stack(b["x"].to_numpy()), centroids)
                yield pd.DataFrame({"vec_id": b["vec_id"], "cluster": at.astype("int32"), "d": [str(v) for v in d]})

    assigned = stored(kept.mapInPandas(assign, schema).withColumn("d", F.col("d").cast("decimal(38,0)")), "assigned")
    discard(kept)
    sums = {r.cluster: int(r.d) for r in assigned.groupBy("cluster").agg(F.sum("d").alias("d")).collect()}

    def by_cluster(values: list, kind: str) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)

    def long_or_null(n: int) -> int | None:
        return n if n <= LONG_MAX else None

    inertias = [long_or_null(sums.get(k, 0)) for k in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    distance = F.when(F.col("d") <= F.lit(LONG_MAX), F.col("d")).cast("long")
    return assigned.select("vec_id", "cluster", distance.alias("distance"), by_cluster(inertias, "long").alias("cluster_inertia"), F.lit(long_or_null(sum(sums.values()))).cast("long").alias("inertia"), by_cluster(digests, "string").alias("centroid_sha256"))
