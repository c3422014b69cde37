"""Writers: subtitle files, review rows and transcripts. Spark's commit protocol replaces whole results only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cues import srt_files


def write_srt(cues: DataFrame, keys: Sequence[str], path: str) -> None:
    """A text for each clip, in folders by clip."""
    srt_files(cues, keys).select(*keys, F.col("srt").alias("value")).write.mode("overwrite").partitionBy(*keys).text(path)


def review_rows(cues: DataFrame, doubts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, review: a JSON row for each cue with its times (two places, half even), texts and doubts."""
    kinds = doubts.groupBy(*keys, "number").agg(F.array_sort(F.collect_set("kind")).alias("doubts"))
    d = cues.join(kinds, [*keys, "number"], "left")
    two = lambda c: F.bround(F.col(c) / 1000, 2).alias(c.removesuffix("_ms"))
    return d.select(*keys, "number", F.to_json(F.struct(two("start_ms"), two("end_ms"), "text", F.coalesce("doubts", F.array().cast("array<string>")).alias("doubts"))).alias("review"))


def keep_transcript(words: DataFrame, derive_key: str, path: str) -> None:
    """Words under the key of the settings and code that made them."""
    words.withColumn("derive_key", F.lit(derive_key)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("derive_key").parquet(path)


def kept_transcript(spark, derive_key: str, path: str) -> DataFrame | None:
    """The words kept under the key, or None if there are none: only that folder is read."""
    d = spark.read.parquet(path).where(F.col("derive_key") == derive_key)
    return None if d.isEmpty() else d.drop("derive_key")
