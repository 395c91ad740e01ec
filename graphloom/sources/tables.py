"""Corpus documents from tables: (id, title, source, domain, text, metadata)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import url_authority

COLUMNS = ["id", "title", "source", "domain", "text", "metadata"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_documents(docs: DataFrame) -> DataFrame:
    number = F.col("doc_id").cast("string")
    source = F.coalesce("source", F.lit("unknown"))
    return docs.select(
        F.concat(F.lit("doc:"), number).alias("id"), F.concat_ws(" ", source, number).alias("title"), F.concat(F.lit("docs://"), source, F.lit("/"), number).alias("source"),
        source.alias("domain"), F.coalesce("text", F.lit("")).alias("text"), F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"),
    )


def from_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    """Pages whose text has been extracted into the column `text`."""
    number = F.col("page_id").cast("string")
    return pages.select(
        F.concat(F.lit("page:"), number).alias("id"), F.concat_ws(" ", url_authority(F.col("url")), number).alias("title"), F.col("url").alias("source"),
        url_authority(F.col("url")).alias("domain"), F.coalesce(text, F.lit("")).alias("text"), F.create_map(F.lit("source_type"), F.lit("url")).alias("metadata"),
    )


def from_conversations(conversations: DataFrame) -> DataFrame:
    """One document for each conversation, its turns in order."""
    turns = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    joined = conversations.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: F.concat_ws(": ", t["role"], t["text"])), "\n").alias("text"))
    number = F.col("conv_id").cast("string")
    return joined.select(
        F.concat(F.lit("chat:"), number).alias("id"), F.concat_ws(" ", F.lit("conversation"), number).alias("title"), F.concat(F.lit("chat://"), number).alias("source"),
        F.lit("chat").alias("domain"), "text", F.create_map(F.lit("source_type"), F.lit("chat")).alias("metadata"),
    )
