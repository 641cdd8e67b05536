"""Findings as a stream: deduplicated, watermarked, counted by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(stream: DataFrame, column: str = "ts", late: str = "10 minutes") -> DataFrame:
    """With a watermark; timestamps without a zone become instants first."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def firing_by_window(stream: DataFrame, key: str, status: str, size: str = "1 hour", slide: str | None = None, column: str = "ts") -> DataFrame:
    w = F.window(column, size, slide) if slide else F.window(column, size)
    s = F.col(status)
    out = stream.groupBy(w.alias("w"), key).agg(F.count_if(s == "error").alias("fires"), F.count("*").alias("applies"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "fires", "applies")


def unique_findings(stream: DataFrame, keys: list[str]) -> DataFrame:
    """One finding a key while the watermark remembers it."""
    return stream.dropDuplicatesWithinWatermark(keys)


def sessions(stream: DataFrame, key: str, gap: str = "30 minutes", column: str = "ts") -> DataFrame:
    out = stream.groupBy(F.session_window(column, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
