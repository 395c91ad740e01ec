"""Streaming ingestion, an extension: new documents become chunks and concepts as they arrive, and a table of documents is
kept up with a stream of their editions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunks, extract
from ..plans import store


def start(documents: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the concepts of each batch of a stream of documents below `path`. Ids come from content, so a batch that runs
    again after a failure writes what it wrote before, into its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        extract.nodes(chunks.chunk(batch)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once(documents: DataFrame, time: str = "edited_at", within: str = "1 hour") -> DataFrame:
    """A stream of documents (id, text, a time and others) with content_id, a hash of id and text, each edition once while
    its time is within `within` of the latest: the state holds as many ids as that. Editions without a time pass."""
    named = documents.withColumn("content_id", F.sha2(F.to_json(F.struct("id", "text")), 256))
    return named.withWatermark(time, within).dropDuplicatesWithinWatermark(["content_id"])


def keep_up(documents: DataFrame, path: str, checkpoint: str, time: str = "edited_at", within: str = "1 hour", buckets: int = 16) -> StreamingQuery:
    """Keep the table at `path` at the latest edition of each document of a stream. Copies that come again within the
    watermark are dropped by state; later ones, late editions and batches that run twice change nothing, since an edition
    only takes the place of an earlier one (`store.merge`)."""

    def write(batch: DataFrame, number: int) -> None:
        store.merge(batch, path, "id", time, buckets)

    stream = once(documents, time, within)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
