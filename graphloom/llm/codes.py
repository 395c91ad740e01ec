"""Vector code compression: product codes whose assignments are pruned by LAESA pivots.

Vectors are cut into parts; each part position has a codebook of its own. Some parts of the first codebook are the fixed
pivots of a position. The distances from every part to its pivots are computed once and stored with the row. In each round
the few distances from pivots to codebook entries give, by the triangle inequality, |d(part, pivot) - d(entry, pivot)| as a
lower bound of every part's distance to every entry. Entries are taken in the order of their bounds and compared exactly, in
integers, until the bound is above the best exact distance; bounds are given a margin well above their rounding, so that
entries at the same distance are always compared and the lower index wins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_join
from .integers import Sums, blocks, finite, integers, listed, matrix, means

#: Scale of the components, parts of a vector, entries of a codebook, rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Pivots of a part position; what a bound must be above the best distance by.
PIVOTS, MARGIN = 4, 1e-4


def choose_pivots(entries: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Entries that are far apart: the first one, then always the one farthest from all that are chosen."""
    chosen = [0]
    while len(chosen) < min(most, len(entries)):
        chosen.append(int(lengths(entries, entries[chosen]).min(1).argmax()))
    return entries[chosen]


def lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances from each row of x to each row of y."""
    apart = x[:, None] - y[None]
    return np.sqrt(np.einsum("ijk,ijk->ij", apart, apart))


def nearest(x: np.ndarray, entries: np.ndarray, to_pivots: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each part its nearest entry (ties: the lower index), the squared distance, and how many exact evaluations all
    parts took. `to_pivots` holds the parts' distances to the pivots."""
    bound = np.abs(to_pivots[:, :, None] - lengths(pivots, entries)[None]).max(1)
    order = bound.argsort(1, "stable")
    bound = np.take_along_axis(bound, order, 1) - MARGIN
    best, who = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(entries))
    rows, taken = np.arange(len(x)), 0
    for turn in range(len(entries)):
        rows = rows[bound[rows, turn] <= np.sqrt(best[rows])]
        if not len(rows):
            break
        one = order[rows, turn]
        apart = x[rows] - entries[one]
        d = np.einsum("ij,ij->i", apart, apart)
        taken += len(rows)
        better = (d < best[rows]) | ((d == best[rows]) & (one < who[rows]))
        best[rows[better]], who[rows[better]] = d[better], one[better]
    return who, best, taken


def compressed(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(`id`, `label`, code array<int>, error) of every vector without null or non-finite components, and the codebooks
    (position, entry, component).

    Vectors are of the length that most of them have (ties: the longer one), if `parts` divides it; those of other lengths
    stay, with a null code and error. The first entries come from the smallest ids, rows of one id in the order of their
    vectors, null ids last; fewer vectors give fewer entries. Repeated rows get the same code, ties the lower index. An empty
    table gives an empty result. Components beyond 2^27 / scale count as that. Other columns are not read."""
    kept = cut(vectors.where(finite(F.col(vector))).select(F.col(id).alias("id"), F.col(label).alias("label"), integers(F.col(vector), scale).alias("v")))
    usual = kept.where((F.size("v") > 0) & (F.size("v") % parts == 0)).groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    named = [F.col("id").alias(id), F.col("label").alias(label)]
    none = kept.select(*named, F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("long").alias("error"))
    if usual is None:
        return none, np.zeros((parts, 0, 0), np.int64)
    dims, width = usual["dims"], usual["dims"] // parts
    same, others = kept.where(F.size("v") == dims), kept.where(F.size("v") != dims)
    rows = same.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    books = np.array([r["v"] for r in rows], np.int64).reshape(len(rows), parts, width).swapaxes(0, 1)
    pivots = [choose_pivots(b) for b in books]
    each = len(pivots[0])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            x = matrix(part.column(2)).reshape(-1, parts, width)
            far = np.stack([lengths(x[:, i], pivots[i]) for i in range(parts)], 1).reshape(len(x), parts * each)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(far), pa.list_(pa.float64()))], ["id", "label", "v", "far"])

    ready = cut(same.mapInArrow(measured, same.withColumn("far", F.lit(None).cast("array<double>")).schema))

    def codes(part: pa.RecordBatch, now: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, far = matrix(part.column(part.schema.get_field_index("v"))).reshape(-1, parts, width), matrix(part.column(part.schema.get_field_index("far")), float).reshape(-1, parts, each)
        found = [nearest(x[:, i], now[i], far[:, i], pivots[i]) for i in range(parts)]
        return x, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)

    def summed(now: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = Sums(now.shape[0] * now.shape[1], width)
            for part in blocks(batches):
                x, code, _ = codes(part, now)
                sums.add((code + np.arange(parts) * now.shape[1]).ravel(), x.reshape(-1, width))
            yield sums.batch()

        return run

    for _ in range(rounds):
        books = means(ready.select("v", "far").mapInArrow(summed(books), Sums.SCHEMA), books.reshape(-1, width)).reshape(books.shape)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            _, code, error = codes(part, books)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(code.astype(np.int32)), pa.list_(pa.int32())), pa.array(error.sum(1))], [id, label, "code", "error"])

    found = ready.mapInArrow(coded, none.select("*").schema)
    rest = others.select(*named, F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("long").alias("error"))
    return cut(found.union(rest)), books


def report(found: DataFrame, books: np.ndarray, id: str = "vec_id", label: str = "label") -> DataFrame:
    """(`id`, code string, error, label_error, codebooks_sha256): codes in hexadecimal; errors summed over equal labels,
    nulls together (null where a sum is beyond a long). A label that many rows share is split over tasks."""
    key = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit(""))
    rows = found.select(F.col(id), key.alias("key"), F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "").alias("code"), "error")
    sums = rows.groupBy("key").agg(F.try_sum("error").alias("label_error"))
    digest = hashlib.sha256(listed(books).encode()).hexdigest()
    return spread_join(rows, sums, "key", id).select(id, "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def restored(code: np.ndarray, books: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Vectors from codes (rows of entries): each part is its codebook's entry, at the middle of its integers."""
    return np.concatenate([(books[i][code[:, i]] + 0.5) / scale for i in range(len(books))], 1)
