"""Streaming counterparts of the weekly alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def windowed_last(stream: DataFrame, time: str, keys: list[str], value: str, size: str = "7 days", late: str = "1 day") -> DataFrame:
    """Count, sum and last value in tumbling windows; rows later than the watermark are dropped.

    Works on batch and streaming DataFrames alike (times without zone are read in the session's); state is one row per open window and key.
    """
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return rows.groupBy(F.window(time, size).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max_by(value, time).alias("last_value")
    ).select(F.col("w.start").alias("window_start"), *keys, "n", "total", "last_value")


def known_by(facts: DataFrame, time: str, late: str = "1 day") -> DataFrame:
    """Running totals of realised facts per day, for point-in-time counts on a stream."""
    rows = facts.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return rows.groupBy(F.window(time, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "n")
