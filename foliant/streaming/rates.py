"""Rates and duplicate suppression over request streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_rates(requests: DataFrame, ts: str, keys: list[str], window: str = "1 minute", slide: str | None = None,
                   late: str = "5 minutes") -> DataFrame:
    """Requests and failures per event-time window; rows later than ``late`` are dropped."""
    frame = F.window(ts, window, slide) if slide else F.window(ts, window)
    counts = requests.withWatermark(ts, late).groupBy(frame.alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") >= 400).alias("failed"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "requests", "failed")


def sessions(requests: DataFrame, ts: str, keys: list[str], gap: str, late: str | None = None) -> DataFrame:
    """Runs of requests of one key with less than ``gap`` between them, of a table or a stream.

    On a stream a session grows while its rows come, is joined to the one that a later row bridges to, and comes out
    once no row within ``late`` of the newest can extend it. Rows of one key are put together where they are read
    before they are shuffled, so a busy key sends its runs and not its rows.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    rows = requests.withWatermark(ts, late) if requests.isStreaming else requests
    # Spark joins sessions that touch, so the gap is taken a microsecond short
    counts = rows.groupBy(F.session_window(ts, f"{gap} -1 microseconds").alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") >= 400).alias("failed"))
    return counts.select(*keys, F.col("w.start").alias("session_start"), (F.col("w.end") + F.expr("INTERVAL 1 MICROSECOND")).alias("session_end"), "requests", "failed")


def drop_repeats(requests: DataFrame, ts: str, keys: list[str], within: str = "10 seconds") -> DataFrame:
    """Keep the first of equal requests that arrive within ``within`` of each other."""
    return requests.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)
