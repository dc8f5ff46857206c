"""Centroid clustering in integers, with partial-distance search.

Components become integers (1024 steps a unit), so that distances, sums and centroids are exact and don't depend on the order of rows.
In a round each task assigns its vectors batch by batch: squared differences are accumulated over blocks of dimensions, those that
vary most first; a vector abandons a centroid once its partial sum is strictly above its best full distance, and the centroids that
survive finish all dimensions. Tasks put out counts and sums per centroid, which Spark adds up; the driver holds the centroids alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

DIMENSIONS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Dimensions that are added at a time.
BLOCK = 8
#: Components are kept within LARGEST; up to SMALL in size, 64-bit sums of squares can't overflow, and beyond it Python's integers are used.
LARGEST, SMALL = 1 << 62, 1 << 26
MOST = (1 << 63) - 1


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """Integer vectors as rows: 64-bit numbers, or Python's integers where squares could overflow."""
    q = np.array(column.flatten()).reshape(-1, dimensions)
    return q if not q.size or max(int(q.max()), -int(q.min())) <= SMALL else q.astype(object)


def assign(q: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row (ties: the smaller number) and its squared distance."""
    if q.dtype == object or max(map(abs, centroids.ravel().tolist())) > SMALL:
        q, centroids = q.astype(object), centroids.astype(object)
    blocks = [order[k : k + BLOCK] for k in range(0, len(order), BLOCK)]

    def add(rows: np.ndarray, k: int | np.ndarray, block: np.ndarray) -> np.ndarray:
        gap = q[np.ix_(rows, block)] - (centroids[k][block] if np.isscalar(k) else centroids[np.ix_(k, block)])
        return (gap * gap).sum(1)

    every = np.arange(len(q))
    opening = np.stack([add(every, k, blocks[0]) for k in range(len(centroids))])
    cluster = opening.argmin(0)  # a good first bound: the centroid that is closest over the first block
    best = opening[cluster, every]
    for block in blocks[1:]:
        best = best + add(every, cluster, block)
    first = cluster.copy()
    for k in range(len(centroids)):
        rows = np.flatnonzero((first != k) & (opening[k] <= best))
        partial = opening[k][rows]
        for block in blocks[1:]:
            partial = partial + add(rows, k, block)
            stays = partial <= best[rows]
            rows, partial = rows[stays], partial[stays]
        better = (partial < best[rows]) | (k < cluster[rows])
        rows, partial = rows[better], partial[better]
        cluster[rows], best[rows] = k, partial
    return cluster, best


def _round(centroids: np.ndarray, order: np.ndarray):
    """Counts and sums of the vectors nearest to each centroid: (k, at, s), at -1 for the count; sums as text, as they may be long."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = [0] * len(centroids), np.zeros((len(centroids), len(order)), object)
        for b in batches:
            q = matrix(b.column("q"), len(order))
            if len(q):
                cluster, _ = assign(q, centroids, order)
                for k in np.unique(cluster).tolist():
                    counts[k] += int((cluster == k).sum())
                    sums[k] += q[cluster == k].sum(0).astype(object)
        rows = [(k, at, str(s)) for k, n in enumerate(counts) if n for at, s in [(-1, n), *enumerate(sums[k])]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 3, (pa.int32(), pa.int32(), pa.string()))], ["k", "at", "s"])

    return task


def _assigned(centroids: np.ndarray, order: np.ndarray):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = matrix(b.column("q"), len(order))
            if len(q):
                cluster, best = assign(q, centroids, order)
                best = np.array([min(x, MOST) for x in best.tolist()], np.int64)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(cluster, pa.int32()), pa.array(best)], ["id", "cluster", "distance"])

    return task


def _total(column: str) -> F.Column:
    """A sum of longs, kept within 64 bits."""
    return F.least(F.sum(F.col(column).cast("decimal(20,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS) -> DataFrame:
    """One row per usable vector: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, centroid.

    Usable are vectors of exactly `dimensions` components, none null or non-finite; others give no row. Centroids start as the usable
    vectors with the smallest SHA-256 of `seed:id` (a null id as an empty text; equal ids in the order of their components), fewer
    where there are fewer. A component's integer is kept within 2^62 in size, and a distance or a sum of distances ends at 2^63 - 1.
    Repeated rows are rows of their own; other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    x = F.col(vector_col).cast("array<double>")
    whole = lambda v: F.when(F.abs(v * SCALE) < float(LARGEST), F.floor(v * SCALE)).otherwise(F.signum(v).cast("long") * F.lit(LARGEST))
    usable = F.coalesce((F.size(x) == dimensions) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    rows = stash(df.where(usable).select(F.col(id_col).cast("long").alias("id"), F.transform(x, whole).alias("q")))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    start = [r.q for r in rows.orderBy(hashed, "q").limit(clusters).collect()]
    numbers = lambda rows: np.array(rows, object).reshape(-1, dimensions)
    centroids = numbers(start)
    spread = rows.select(F.posexplode("q").alias("at", "v")).groupBy("at").agg(F.variance("v").alias("v")).collect()
    varies = {r["at"]: r["v"] or 0.0 for r in spread}
    order = np.array(sorted(range(dimensions), key=lambda d: -varies.get(d, 0.0)))
    narrow = lambda c: c.astype(np.int64) if c.size and max(map(abs, c.ravel().tolist())) <= SMALL else c
    for _ in range(rounds if len(centroids) else 0):
        sums = rows.mapInArrow(_round(narrow(centroids), order), "k int, at int, s string")
        found = {(r["k"], r["at"]): int(r["s"]) for r in sums.groupBy("k", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
        moved = numbers([[found[k, d] // found[k, -1] for d in range(dimensions)] if (k, -1) in found else list(c) for k, c in enumerate(centroids)])
        if (moved == centroids).all():  # every further round would give the same
            break
        centroids = moved
    if not len(centroids):
        named = rows.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false")
    else:
        named = stash(rows.mapInArrow(_assigned(narrow(centroids), order), "id long, cluster int, distance long"))
    per = named.groupBy("cluster").agg(_total("distance").alias("cluster_inertia"))
    total = named.agg(_total("distance").alias("inertia"))
    final = [(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest(), [int(v) for v in c]) for k, c in enumerate(centroids.tolist())]
    known = df.sparkSession.createDataFrame(final, "cluster int, centroid_sha256 string, centroid array<long>")
    out = named.join(F.broadcast(per.join(known, "cluster").join(total, how="cross")), "cluster")  # one row a centroid
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
