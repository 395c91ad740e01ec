"""Chunks of at most so many characters with exact spans in the collapsed text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "document_id string, title string, source string, domain string, ordinal int, start int, end int, text string"


def cut_points(text: str, most: int) -> Iterator[tuple[int, int]]:
    """Start and end of each chunk: at most `most` characters, ended after the last ". " that is over 80 characters in."""
    start = 0
    while start < len(text):
        end = min(len(text), start + most)
        if end < len(text) and (stop := text.rfind(". ", start, end)) > start + 80:
            end = stop + 1
        yield start, end
        start = end
        while start < len(text) and text[start].isspace():
            start += 1


def chunk(docs: DataFrame, most: int = 360) -> DataFrame:
    """Chunks of documents, with chunk_id and the evidence span. Each document is cut by itself, so this shuffles nothing.
    Empty texts have no chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, title, source, domain, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = " ".join((text or "").split())
                kept = ((a, b, t) for a, b in cut_points(text, most) if (t := text[a:b].strip()))
                rows += [(doc, title, source, domain, i, a, b, t) for i, (a, b, t) in enumerate(kept)]
            columns = zip(*rows, strict=True) if rows else [()] * 8
            kinds = [pa.string()] * 4 + [pa.int32()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["document_id", "title", "source", "domain", "ordinal", "start", "end", "text"])

    found = docs.select("id", "title", "source", "domain", "text").mapInArrow(run, SCHEMA)
    span = F.struct(F.col("source").alias("uri"), "start", "end", "text")
    return found.withColumn("chunk_id", F.concat(F.col("document_id"), F.lit(":chunk:"), F.col("ordinal").cast("string"))).withColumn("evidence", span)


def doclets(docs: DataFrame, most: int = 150) -> DataFrame:
    """Each chunk as a document of its own, taken in turn from all documents: first all first chunks, then all second ones."""
    parts = chunk(docs, most)
    return parts.select(
        F.col("ordinal").alias("round"), F.col("document_id").alias("parent_id"),
        F.concat(F.col("document_id"), F.lit(":doclet:"), F.col("ordinal").cast("string")).alias("id"), "title", F.concat(F.col("source"), F.lit("#"), F.col("ordinal").cast("string")).alias("source"), "domain", "text",
    )
