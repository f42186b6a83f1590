"""Streaming extensions: idempotent ingest, and an online gate on keys seen in two splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest(spark: SparkSession, source: str, schema: str, event_time: str, key: str, out: str, checkpoint: str, delay: str = "1 day"):
    """Append files' rows once per key (within the watermark); run what is there, then stop."""
    rows = spark.readStream.schema(schema).parquet(source).withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, event_time: str, by: str, width: str = "1 hour", delay: str = "1 day") -> DataFrame:
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width), by).agg(F.count("*").alias("n"))


def online_gate(stream: DataFrame, key: str, split: str) -> DataFrame:
    """Running state per key: whether it stands in more than one split."""
    return stream.groupBy(key).agg(F.min(split).alias("low"), F.max(split).alias("high")).where("low <> high").select(key)
