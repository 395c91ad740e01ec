"""The folder that driver and executors share, and what is kept in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that are broadcast at most.
BROADCAST_IDS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session gets a temporary folder; on a cluster that is an error, since
    executors would write to disks of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a written table in the shared folder."""
    return f"{shared_dir(spark)}/graphloom-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and keep it in the shared folder, so that lost executors take nothing with them."""
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """The same as `cut`, as a Parquet table: large tables take a fraction of the disk that a checkpoint takes."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_few(table: DataFrame, key: str, ids: DataFrame, column: str = "node_id") -> DataFrame:
    """The rows of `table` whose `key` is among `ids` where these are few enough to be broadcast, so that nothing else of it
    is shuffled by the join that follows; else all of `table`. `ids` is computed twice, so it wants to be cut."""
    asked = ids.select(F.col(column).alias(key)).distinct()
    return table.join(F.broadcast(asked), key, "left_semi") if asked.count() <= BROADCAST_IDS else table
