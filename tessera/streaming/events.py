"""Structured Streaming counterparts (extensions; the batch operators are the reference for their results)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, folder: str) -> DataFrame:
    """The events table's Parquet files as a stream."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(folder)


def deduplicated(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def minute_bars(stream: DataFrame, delay: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    w = stream.withWatermark("ts", delay).groupBy(F.window("ts", width), "user_id")
    return w.agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").alias("n")).select(F.col("window.start").alias("minute"), "user_id", "open", "high", "low", "close", "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    w = stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id")
    return w.agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("begin"), "user_id", "n")
