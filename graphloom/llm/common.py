"""What the operators of this subpackage share: tables, lineage cuts, row slices and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import cut, scratch  # noqa: F401

#: Bytes of text that the numpy steps take at once; their arrays are about 30 times as large.
SLICE_BYTES = 2 << 20
#: A key with more than one in so many of all rows, and with more rows than the second number, is split over so many tasks
#: when its rows meet what belongs to the key.
HOT_SHARE, HOT_ROWS, HOT_PARTS = 4096, 256, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(columns: list[str], *names: str) -> list[str]:
    """Names like the given ones that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """`left` joined to `right` (one row for a key) without a task that takes all rows of a hot key: those, HOT_SHARE keys at
    most, and null keys are split by a hash of the column `by`, and their rows of `right` are repeated for each part."""
    hot, part = free([*left.columns, *right.columns], "_hot", "_part")
    counted = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(hot))
    few = F.broadcast(counted.where((F.col(hot) * F.lit(HOT_SHARE) > F.lit(left.count())) & (F.col(hot) > HOT_ROWS)).select(key, F.lit(True).alias(hot)))
    parts = F.when(F.col(hot) | F.col(key).isNull(), F.pmod(F.xxhash64(by), F.lit(HOT_PARTS))).otherwise(0).cast("int")
    a = left.join(few, key, "left").withColumn(part, parts).drop(hot)
    b = right.join(few, key, "left").withColumn(part, F.explode(F.sequence(F.lit(0), F.when(F.col(hot), HOT_PARTS - 1).otherwise(0)))).drop(hot)
    return a.join(b, [key, part], how).drop(part)


def share_of(key: Column, share: float) -> Column:
    """Whether a row is of about such a share of all rows, by a hash of its key: a sample without an order, so that no task
    and not the driver has to rank rows."""
    return F.pmod(F.xxhash64(key, F.lit("share")), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30)))


def binary(column: pa.Array) -> pa.LargeBinaryArray:
    """A string column as UTF-8 bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def bytes_of(column: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the rows, and where each row begins (one entry more than rows)."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of the batches with the bytes of their text and its offsets, about `limit` bytes at a time and a row at least."""
    for batch in batches:
        column = binary(batch.column(batch.schema.get_field_index(text)))
        if not len(column):
            continue
        at = bytes_of(column)[1]
        low = 0
        while low < len(column):
            high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
            part = column.slice(low, high - low)
            yield (batch.slice(low, high - low), *bytes_of(part))
            low = high


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of `edges` (a, b) reaches. Nodes without an edge are not returned.

    Alternating large-star and small-star steps: each node hangs its larger neighbours under the smallest one, then
    its smaller neighbours. The edges stay as many as the nodes, and every step is an aggregate and a join by node.
    """
    pairs = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = spread_join(both.where("b > a"), low, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        new = cut(small)
        moved = new.exceptAll(pairs).limit(1).count() or pairs.exceptAll(new).limit(1).count()
        pairs = new
        if not moved:
            break
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(pairs.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
