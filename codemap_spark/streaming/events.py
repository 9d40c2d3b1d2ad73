"""Event-log streams (an extension: the batch queries' running counterparts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def daily_activity(events: DataFrame, late: str = "1 day") -> DataFrame:
    """day, event_type, events; rows later than ``late`` fall away."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = ts.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("events"))
    return counted.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "events")
