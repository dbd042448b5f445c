"""Message counts and sessions over event time, with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, keys: list[str], size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows and distinct keys per window; works on batch and streaming tables alike."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n"
    )


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key: rows not further apart than ``gap``."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count("*").alias("n")).select(
        key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n"
    )


def first_of_id(events: DataFrame, id_col: str, ts: str, late: str = "1 day") -> DataFrame:
    """Rows whose id was not seen within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([id_col])
