"""Streaming forms of the usage operators; the batch operators are the truth for late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How late an event may come.
LATE = "1 hour"


def session_windows(usage: DataFrame, gap: str = "20 minutes", late: str = LATE) -> DataFrame:
    """Sessions of the one log that usage is: start, end, events, tokens, empties.

    Two events exactly gap apart belong together, as in the batch form.  Streams
    need a key beside a session window; log is one value for all events.
    """
    key = F.session_window("ts", gap)
    log = (F.col("event_id") * 0).alias("log")
    return (
        usage.withWatermark("ts", late).groupBy(log, key.alias("w")).agg(F.count("*").alias("events"), F.sum("tokens").alias("tokens"), F.count_if("empty").alias("empties"), F.max("ts").alias("end"))
        .select(F.unix_micros("w.start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events", "tokens", "empties")
    )


def velocity_windows(usage: DataFrame, width: str = "7 days", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Events and tokens of each tumbling, or with slide sliding, window and mode."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return usage.withWatermark("ts", late).groupBy(w.alias("w"), "mode").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).select(F.unix_micros("w.start").alias("start_us"), "mode", "n", "tokens")


def distinct_events(usage: DataFrame, late: str = LATE) -> DataFrame:
    """Events whose id hasn't come within the watermark."""
    return usage.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
