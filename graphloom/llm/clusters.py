"""Centroid clustering by the threshold algorithm.

Each dimension has a list of the centroids, sorted by their component. A vector enters every list at the place of its own
component and walks outward, one step in every list at a time, always to the nearer side. Each centroid that it meets for the
first time is compared exactly. A centroid that no list has shown yet lies at least as far away in each dimension as the last
step there, so its squared distance is at least the sum of the squared steps (the frontier): once that is strictly above the
best exact distance, no other centroid can be nearer or as near, and the walk ends. It also ends when all have been met.

Rows never move: a round is one pass that hands on the sums of a task's clusters, and the driver gets as many numbers as the
centroids have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free
from .integers import Sums, blocks, finite, integers, listed, matrix, means

#: Components of a vector, their scale, centroids, rounds.
DIMS, SCALE, CENTROIDS, ROUNDS = 64, 256, 40, 5
FAR = np.int64(1) << 31


def sorted_lists(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each dimension the centroids' components in ascending order, between two that nothing reaches, and their numbers."""
    order = np.argsort(centroids, 0, "stable").T
    values = np.take_along_axis(centroids.T, order, 1)
    edge = np.full((len(values), 1), FAR)
    return np.hstack([-edge, values, edge]), order


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row its nearest centroid (ties: the smaller number), the squared distance, and how many centroids were
    compared exactly."""
    k, dims = centroids.shape
    values, order = sorted_lists(centroids)
    best, who = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), k)
    seen = np.zeros((len(x), k), bool)
    at = np.arange(dims)
    rows = np.arange(len(x))
    low = np.stack([np.searchsorted(values[j], x[:, j], "right") - 1 for j in at], 1) if len(x) else np.zeros((0, dims), int)
    high = low + 1
    while len(rows):
        here = x[rows]
        down, up = here - values[at, low], values[at, high] - here
        nearer = down <= up
        met = order[at, np.where(nearer, low, high) - 1]
        frontier = np.minimum(down, up)
        low, high = low - nearer, high + ~nearer
        fresh = np.zeros((len(rows), k), bool)
        np.put_along_axis(fresh, met, True, 1)
        r, c = np.nonzero(fresh & ~seen[rows])
        apart = here[r] - centroids[c]
        exact = np.full((len(rows), k), np.iinfo(np.int64).max)
        exact[r, c] = np.einsum("ij,ij->i", apart, apart)
        seen[rows] |= fresh
        one = exact.argmin(1)  # the first of the least
        d = exact[np.arange(len(rows)), one]
        better = (d < best[rows]) | ((d == best[rows]) & (one < who[rows]))
        best[rows[better]], who[rows[better]] = d[better], one[better]
        on = (np.einsum("ij,ij->i", frontier, frontier) <= best[rows]) & ~seen[rows].all(1)
        rows, low, high = rows[on], low[on], high[on]
    return who, best, seen.sum(1)


def first_centroids(kept: DataFrame, k: int) -> np.ndarray:
    """The vectors whose ids have the k smallest hashes, in their order; rows of one id in the order of their vectors."""
    key = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = kept.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def clustered(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS) -> tuple[DataFrame, np.ndarray]:
    """(`id`, cluster, distance) of every vector with `dims` finite components, and the final centroids.

    Null vectors, other lengths, null and non-finite components are left out. A null id counts as an empty one in the order
    of first centroids. Fewer vectors than k are a centroid each; repeated rows and ties go to the smaller number; a table
    without such vectors gives an empty result. Components beyond 2^27 / scale count as that. Other columns are not read."""
    kept = vectors.where(finite(F.col(vector)) & (F.size(vector) == dims)).select(F.col(id).alias("id"), integers(F.col(vector), scale).alias("v"))
    kept = cut(kept)
    centroids = first_centroids(kept, k)
    none = kept.select(F.col("id").alias(id), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("1 = 0")
    if not len(centroids):
        return none, centroids

    def summed(now: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = Sums(*now.shape)
            for part in blocks(batches):
                x = matrix(part.column(0))
                sums.add(nearest(x, now)[0], x)
            yield sums.batch()

        return run

    for _ in range(rounds):
        centroids = means(kept.select("v").mapInArrow(summed(centroids), Sums.SCHEMA), centroids)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            who, distance, _ = nearest(matrix(part.column(1)), centroids)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(who, pa.int32()), pa.array(distance)], [id, "cluster", "distance"])

    return cut(kept.select("id", "v").mapInArrow(assigned, none.schema)), centroids


def report(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """`assigned` with cluster_inertia, inertia (the distances summed over a row's cluster and over all rows; null where a
    sum is beyond a long) and centroid_sha256. A row for each centroid is all that is broadcast."""
    each = {r["cluster"]: r["d"] for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    fits = lambda n: int(n) if n < 1 << 63 else None
    total = fits(sum(each.values()))
    rows = [(c, fits(d), total, hashlib.sha256(listed(centroids[c]).encode()).hexdigest()) for c, d in each.items()]
    cluster, mine = free(assigned.columns, "_cluster", "_mine")
    told = assigned.sparkSession.createDataFrame(rows, f"{cluster} int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(told), F.col("cluster") == F.col(cluster), "left").drop(cluster, mine)
