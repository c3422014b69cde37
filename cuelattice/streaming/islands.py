"""Islands of intervals as they arrive, in windows that Spark keeps and closes by the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_islands(events: DataFrame, join_us: int, late: str = "1 hour") -> DataFrame:
    """key, s, e, n of islands, each when it has closed; events (key, ts, s, e) later than late are dropped.

    ts is the start as a timestamp. An interval is a session that lasts until its end and the join; sessions that meet
    are one, whatever the order they come in, as in the batch job.
    """
    lasting = F.concat((F.greatest(F.col("e") - F.col("s"), F.lit(0)) + join_us + 1).cast("string"), F.lit(" microseconds"))
    got = events.withWatermark("ts", late).groupBy("key", F.session_window("ts", lasting).alias("__session"))
    return got.agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n")).select("key", "s", "e", "n")


def speech_per_window(events: DataFrame, width: str, hop: str, late: str = "1 hour") -> DataFrame:
    """Speech that starts in each sliding window, by label; windows close with the watermark."""
    w = F.window("ts", width, hop)
    return events.withWatermark("ts", late).groupBy(w, "label").agg(F.count("*").alias("n"), F.sum(F.col("e") - F.col("s")).alias("us")).select(F.col("window.start").alias("start"), "label", "n", "us")


def ask_once(requests: DataFrame, late: str = "1 day") -> DataFrame:
    """Requests without those that repeat one of the last day: the ledger of what has been asked."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["request"])
