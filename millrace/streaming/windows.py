"""Event-time windows and incremental deduplication; the same functions serve batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, time: str, length: str, keys: list[str], value: str, late: str | None = None) -> DataFrame:
    """Counts and sums of windows of ``length``; ``late``: how long a stream waits for late rows."""
    return sliding(events, time, length, length, keys, value, late)


def sliding(events: DataFrame, time: str, length: str, hop: str, keys: list[str], value: str, late: str | None = None) -> DataFrame:
    e = events.withWatermark(time, late) if late else events
    w = F.window(time, length) if hop == length else F.window(time, length, hop)
    g = e.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Sessions of each key that end after ``gap`` without a row."""
    e = events.withWatermark(time, late) if late else events
    g = e.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def first_seen(rows: DataFrame, keys: list[str], time: str | None = None, late: str | None = None) -> DataFrame:
    """One row for each key. On a stream with ``time`` and ``late`` the state of old keys is given up."""
    if time and late:
        return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return rows.dropDuplicates(keys)
