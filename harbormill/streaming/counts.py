"""Incremental counting: popularity per item over event time, with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, key: str, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, key, n): events per key and window.  Works on streams and on tables; rows without time or key are left out."""
    rows = events.filter(F.col(time).isNotNull() & F.col(key).isNotNull()).withWatermark(time, late)
    return rows.groupBy(F.window(time, length).alias("w"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "key", "n")


def deduplicated(events: DataFrame, ids: list[str], time: str, late: str = "2 days") -> DataFrame:
    """Each event once, where a repetition comes within the watermark; state older than that is dropped."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(ids)


def sessions(events: DataFrame, time: str, user: str, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """(user, start, stop, n): runs of a user's events without a longer pause than ``gap``."""
    rows = events.withWatermark(time, late)
    return rows.groupBy(F.session_window(time, gap).alias("w"), F.col(user).alias("user")).agg(F.count(F.lit(1)).alias("n")).select("user", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")
