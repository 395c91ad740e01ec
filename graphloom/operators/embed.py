"""Hash embeddings, exact top-k by dot product, and the torus layout."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import TURN
from ..functions.shared import written

#: Dimensions of the hash embedding; rows of a block of vectors.
DIMENSIONS, BLOCK = 384, 2048


@functools.lru_cache(1 << 16)
def token_place(token: str, dimensions: int = DIMENSIONS) -> tuple[int, int]:
    """Bucket and sign of a token: the first four bytes of its 8-byte blake2b give the bucket, the fifth the sign."""
    digest = hashlib.blake2b(token.encode(), digest_size=8).digest()
    return int.from_bytes(digest[:4], "little") % dimensions, 1 if digest[4] % 2 == 0 else -1


@functools.lru_cache(1 << 16)
def token_place_sha1(token: str, dimensions: int = DIMENSIONS) -> tuple[int, int]:
    """The same by SHA-1, which SQL engines have too: the first eight hexadecimal digits and the ninth."""
    digest = hashlib.sha1(token.encode()).hexdigest()
    return int(digest[:8], 16) % dimensions, 1 if int(digest[8], 16) % 2 == 0 else -1


def hash_embed(rows: DataFrame, text: str = "text", dimensions: int = DIMENSIONS, place=token_place) -> DataFrame:
    """`rows` with a column embedding: signed counts of the lower-case words between white space, at unit length. Texts
    without words have a zero vector. `place` gives the bucket and the sign of a word."""
    return embed_with(rows, HashEmbedder(dimensions, place=place), text)


class Embedder(Protocol):
    """What turns texts into vectors: float32 rows of `dimensions`. Its name and model are part of what an index is made
    with; it is sent to the executors, so it must be picklable."""

    name: str
    model: str
    dimensions: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


@dataclass(frozen=True)
class HashEmbedder:
    """Signed counts of words at unit length. Each different word of a batch is hashed once, and all counts are added up at
    once."""

    dimensions: int = DIMENSIONS
    name: str = "hash"
    model: str = "blake2b"
    place: Callable[[str, int], tuple[int, int]] = token_place

    def embed(self, texts: list[str]) -> np.ndarray:
        words = [t.lower().split() for t in texts]
        numbers: dict[str, int] = {}
        at = np.fromiter((numbers.setdefault(w, len(numbers)) for own in words for w in own), np.int64)
        places = np.array([self.place(w, self.dimensions) for w in numbers], np.int64).reshape(-1, 2)
        row = np.repeat(np.arange(len(texts)), [len(own) for own in words])
        out = np.bincount(row * self.dimensions + places[at, 0], places[at, 1], len(texts) * self.dimensions).reshape(len(texts), self.dimensions)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(length > 0, length, 1)).astype(np.float32)


def embed_with(rows: DataFrame, embedder: Embedder, text: str = "text") -> DataFrame:
    """`rows` with a column embedding of the texts, in the batches that Arrow brings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d = len(batch), embedder.dimensions
            out = embedder.embed([t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]) if n else np.zeros((0, d), np.float32)
            if out.shape != (n, d):
                raise ValueError(f"{embedder.name} gave vectors of shape {out.shape} for {n} texts and {d} dimensions")
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * d, d), pa.int32()), pa.array(out.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "embedding"])

    return rows.mapInArrow(run, rows.select("*").schema.add("embedding", T.ArrayType(T.FloatType())))


def _blocks(rows: DataFrame, prefix: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), BLOCK):
                part = batch.slice(low, BLOCK)
                matrix = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.string())), pa.array([matrix.tobytes()], pa.binary())], [f"{prefix}_ids", f"{prefix}_block"])

    return rows.mapInArrow(run, f"{prefix}_ids array<string>, {prefix}_block binary")


def best_places(score: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest numbers of each row, largest first, ties by place; the rest is not sorted."""
    n = score.shape[1]
    score = np.where(np.isnan(score), -np.inf, score)
    if n <= k:
        return np.argsort(-score, 1, "stable")
    least = np.partition(score, n - k, 1)[:, n - k, None]
    above, level = score > least, score == least
    kept = above | (level & (np.cumsum(level, 1) <= k - above.sum(1, keepdims=True)))  # of equal ones the first
    some = np.nonzero(kept)[1].reshape(len(score), k)
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(score, some, 1), 1, "stable"), 1)


def topk(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(query_id, node_id, score, rank, low): the k items of the largest dot product for every query, ties by node_id, and
    the smallest dot product that the query has with any item.

    A stated set of queries meets all items in blocks of vectors; each pair of blocks gives k rows for a query at most.
    `queries` is (query_id, embedding), `items` is (node_id, embedding); vectors have one length."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q_raw, n_ids, n_raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                q, n = np.frombuffer(q_raw).reshape(len(q_ids), -1), np.frombuffer(n_raw).reshape(len(n_ids), -1)
                order = np.argsort(np.array(n_ids, object), kind="stable")
                score = q @ n[order].T
                top = best_places(np.round(score, 12), k)
                rows = [(q_ids[i], n_ids[order[j]], float(score[i, j]), float(score[i].min())) for i in range(len(q_ids)) for j in top[i]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["query_id", "node_id", "score", "low"])

    met = _blocks(items.select(F.col("node_id").cast("string"), "embedding"), "n").crossJoin(_blocks(queries.select(F.col("query_id").cast("string"), "embedding"), "q"))
    partial = written(met.select("q_ids", "q_block", "n_ids", "n_block").mapInArrow(best, "query_id string, node_id string, score double, low double"), "nearest")  # read twice
    low = partial.groupBy("query_id").agg(F.min("low").alias("low"))
    ranked = partial.drop("low").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "node_id")))
    return ranked.where(F.col("rank") <= k).join(low, "query_id")


def scale_to_torus(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """`points` with theta and phi: both coordinates scaled to [0, 2 pi] over all rows; 0 where a coordinate is constant."""
    ranges = points.agg(*[f(c).alias(f"_{n}_{c}") for c in (x, y) for n, f in (("low", F.min), ("high", F.max))])
    scaled = lambda c: F.when(F.col(f"_high_{c}") > F.col(f"_low_{c}"), (F.col(c) - F.col(f"_low_{c}")) / (F.col(f"_high_{c}") - F.col(f"_low_{c}")) * F.lit(TURN)).otherwise(F.lit(0.0))
    # one row of four numbers
    return points.crossJoin(F.broadcast(ranges)).withColumns({"theta": scaled(x), "phi": scaled(y)}).drop(*[f"_{n}_{c}" for c in (x, y) for n in ("low", "high")])


def torus_layout(vectors: DataFrame) -> DataFrame:
    """`vectors` with theta and phi: the first two principal axes of `embedding`, each with its largest loading positive,
    scaled to the torus. Fewer than two vectors lie at 0."""
    if vectors.limit(2).count() < 2:
        return vectors.withColumns({"theta": F.lit(0.0), "phi": F.lit(0.0)})
    ready = vectors.withColumn("_v", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(ready)
    axes = model.pc.toArray()
    signs = [1.0 if a[np.abs(a).argmax()] >= 0 else -1.0 for a in axes.T]
    p = vector_to_array("_p")
    placed = model.transform(ready).withColumns({"x": p[0] * F.lit(signs[0]), "y": p[1] * F.lit(signs[1])}).drop("_v", "_p")
    return scale_to_torus(placed).drop("x", "y")
