"""Streaming counts over event time: an extension beyond the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed_counts(stream: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts by window and type; rows later than the watermark are left out, once windows close."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width, slide), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def session_counts(stream: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
