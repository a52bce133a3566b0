"""Streaming counterparts: windows over events with late data, and the current state of a review log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hopping(events: DataFrame, width: str, slide: str, late: str) -> DataFrame:
    """Counts and sums by window and type; windows close once the watermark has passed them."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Activity of each user without a pause longer than ``gap``."""
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap))
    return s.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def latest_decisions(log: DataFrame, key: str, revision: str) -> DataFrame:
    """The decision of each key with the highest revision so far; run it in update mode."""
    others = [c for c in log.columns if c != key]
    state = F.max(F.struct(revision, *[c for c in others if c != revision])).alias("s")
    return log.groupBy(key).agg(state).select(key, *[F.col(f"s.{c}").alias(c) for c in others])
