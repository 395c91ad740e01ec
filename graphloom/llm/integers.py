"""Vectors of integers for clustering: exact sums and means, whatever the order of the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integers beyond this are taken as this, so that squared distances of 64 components stay inside 63 bits.
MOST = 1 << 27
#: Rows of a matrix that the numpy steps take at once.
ROWS = 1024


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds only finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) for each component, x as double; MOST at most, -MOST at least."""
    inside = lambda x: F.greatest(F.least(x.cast("double") * F.lit(float(scale)), F.lit(float(MOST))), F.lit(float(-MOST)))
    return F.transform(vector, lambda x: F.floor(inside(x)).cast("int"))


def matrix(column: pa.Array, kind=np.int64) -> np.ndarray:
    """A list column, whose lists are of one length, as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def blocks(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, len(batch), rows):
            yield batch.slice(low, rows)


class Sums:
    """Counts and sums of the rows of each cell, gathered over the blocks of a task."""

    SCHEMA = "cell int, n long, sums array<long>"

    def __init__(self, cells: int, dims: int):
        self.n, self.sums = np.zeros(cells, np.int64), np.zeros((cells, dims), np.int64)

    def add(self, cell: np.ndarray, x: np.ndarray) -> None:
        self.n += np.bincount(cell, minlength=len(self.n))
        np.add.at(self.sums, cell, x)

    def batch(self) -> pa.RecordBatch:
        have = np.flatnonzero(self.n)
        return pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), pa.array(self.n[have]), pa.array(list(self.sums[have]), pa.list_(pa.int64()))], ["cell", "n", "sums"])


def means(partial: DataFrame, now: np.ndarray) -> np.ndarray:
    """`now` (a row for each cell) with floor(sum / count) in place of the rows of cells that have any. As many numbers reach
    the driver as `now` has, whatever the number of rows."""
    each = partial.select("cell", "n", F.posexplode("sums").alias("at", "value"))
    out = now.copy()
    for r in each.groupBy("cell", "at").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).collect():
        out[r["cell"], r["at"]] = r["value"] // r["n"]
    return out


def listed(x: np.ndarray) -> str:
    """Numbers in decimal, joined by commas."""
    return ",".join(map(str, x.ravel().tolist()))
