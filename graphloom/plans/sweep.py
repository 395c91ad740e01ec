"""A sweep over corpus sizes: how index build and strategies do as documents are added."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunks, evaluate
from . import index, strategies
from .report import markdown_table

#: Fixed value: characters of a small document of the sweep.
DOCLET_CHARS = 150
COLUMNS = ("size", "strategy", "build_s", "pass_rate", "source_recall", "path_recall", "faithfulness", "p95_latency_ms", "mean_shard_fanout", "mean_portal_hops")


def sweep(docs: DataFrame, questions: DataFrame, sizes: tuple[int, ...], path: str, names: str = "vector_only,bm25,hybrid_dense_bm25,hybrid_graph_rerank,graph_traversal", most: int | None = 96) -> DataFrame:
    """COLUMNS for each size and strategy. The documents of a size are the first ones of all small parts of `docs`, taken in
    turn from each document; `questions` are labelled as `strategies.scored` takes them."""
    parts = chunks.doclets(docs, DOCLET_CHARS)
    rows = None
    for size in sizes:
        few = parts.orderBy("round", "parent_id").limit(size).select("id", "title", "source", "domain", "text")
        began = time.perf_counter()
        built = index.build(few, f"{path}/{size}/index", most)
        spent = time.perf_counter() - began
        found = strategies.scored(built, questions, f"{path}/{size}/runs", names)
        own = evaluate.summary(found).withColumns({"size": F.lit(size), "build_s": F.lit(round(spent, 3))}).select(*COLUMNS)
        rows = own if rows is None else rows.unionByName(own)
    return rows


def render(rows: DataFrame) -> str:
    """A row for each size and strategy as Markdown."""
    found = rows.orderBy("size", "strategy").collect()
    return "# Scale sweep\n\n" + markdown_table(list(COLUMNS), [[r[c] for c in COLUMNS] for r in found]) + "\n"
