"""Requests as a stream: each key once, whatever batch it comes in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_dedup(requests: DataFrame, *, event_time: str | None = None, watermark: str | None = None) -> DataFrame:
    """The first request of each ``dedup_key`` of a stream; rows that skip deduplication all
    pass, and never enter the state. With a watermark a key is forgotten after that time, so
    the state is bounded; without, all keys are kept."""
    skip = F.coalesce(F.col("skip_dedup"), F.lit(False))
    rows = requests.withWatermark(event_time, watermark) if event_time and watermark else requests
    keyed = rows.filter(~skip)
    once = keyed.dropDuplicatesWithinWatermark(["dedup_key"]) if event_time and watermark else keyed.dropDuplicates(["dedup_key"])
    return once.unionByName(rows.filter(skip))


def status_counts(responses: DataFrame, *, at: str = "ts", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Responses by class and time window of a stream, late ones taken in."""
    from ..operators.http import classify

    rows = responses.withColumn("class", classify(F.col("status_code"))).withWatermark(at, late)
    return rows.groupBy(F.window(at, width).alias("w"), "class").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "class", "n")
