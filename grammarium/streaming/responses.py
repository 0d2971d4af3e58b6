"""Answers that land as JSON lines in a folder: a stream that keeps the first of each request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "custom_id string, response string, received_at timestamp"


def landed(spark: SparkSession, folder: str, delay: str = "1 day") -> DataFrame:
    """One row per request; repeats within `delay` are dropped, later rows than that are ignored."""
    rows = spark.readStream.schema(SCHEMA).json(folder)
    return rows.filter(F.col("custom_id").isNotNull()).withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["custom_id"])


def collect_into(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Appends what has landed to a Parquet folder and stops; run again, it takes up where it stopped."""
    return landed(spark, folder).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
