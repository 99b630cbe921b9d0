"""Streaming forms of batch ideas.  Extensions: the batch operators have no streaming counterpart to match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators.requests import cache_key


def first_requests(stream: DataFrame, *, event_time: str = "ts", text_col: str = "text", late: str = "10 minutes") -> DataFrame:
    """The first request of each cache key within the watermark: what a cache would send on."""
    keyed = stream.withColumn("cache_key", cache_key(F.col(text_col))).withWatermark(event_time, late)
    return keyed.dropDuplicatesWithinWatermark(["cache_key"])


def stage_counts(stream: DataFrame, *, event_time: str = "ts", stage_col: str = "event_type", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events of each stage in tumbling windows."""
    counted = stream.withWatermark(event_time, late).groupBy(F.window(event_time, width), stage_col).agg(F.count("*").alias("events"))
    return counted.select(F.col("window.start").alias("start"), stage_col, "events")
