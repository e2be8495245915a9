"""Windowed aggregates with watermarks, for batch and streaming DataFrames alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_time(df: DataFrame, time: str, late: str | None = None) -> DataFrame:
    """``time`` as a timestamp in the session's zone; with ``late``, rows that are later than that may be dropped by a stream."""
    df = df.withColumn(time, F.col(time).cast("timestamp"))
    return df.withWatermark(time, late) if late else df


def _stats(value: str) -> list:
    return [F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("high")]


def tumbling(df: DataFrame, time: str, value: str, width: str, keys: list[str], late: str | None = None) -> DataFrame:
    d = event_time(df, time, late).groupBy(F.window(time, width), *keys).agg(*_stats(value))
    return d.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "mean", "high")


def sliding(df: DataFrame, time: str, value: str, width: str, step: str, keys: list[str], late: str | None = None) -> DataFrame:
    d = event_time(df, time, late).groupBy(F.window(time, width, step), *keys).agg(*_stats(value))
    return d.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "mean", "high")


def sessions(df: DataFrame, time: str, value: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    d = event_time(df, time, late).groupBy(F.session_window(time, gap), *keys).agg(*_stats(value))
    return d.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n", "mean", "high")


def deduplicated(df: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """First row of each key within the watermark (all rows of a batch)."""
    d = event_time(df, time, late)
    return d.dropDuplicatesWithinWatermark(keys) if df.isStreaming else d.dropDuplicates(keys)
