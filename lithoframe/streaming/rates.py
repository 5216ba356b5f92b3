"""Event rates over a stream. The reference has no streams; this is an extension of its rate windows and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, by: str, width: str = "60 seconds", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """window_start, group, n; rows later than ``late`` behind the newest are dropped, windows come out once they can't change. The same plan runs on a batch."""
    source = events.withWatermark(ts, late) if events.isStreaming else events
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return source.groupBy(w.alias("w"), F.col(by).alias("group")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "group", "n")


def over_limit(events: DataFrame, ts: str, by: str, limit: int, width: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Windows in which a group passed the limit."""
    return windowed_counts(events, ts, by, width, late=late).filter(F.col("n") > limit)
