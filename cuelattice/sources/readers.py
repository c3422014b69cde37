"""Readers of transcripts, replies and scripts: text in, typed rows out. Missing fields take their defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRANSCRIPT = "language string, text string, words array<struct<text: string, start: double, end: double, speaker: string, score: double, source: string, backed: int, local: boolean>>"
REPLY = "struct<start: double, end: double, speaker: string, text: string>"


def _us(seconds: Column) -> Column:
    return F.bround(seconds * 1_000_000, 0).cast("long")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """One row for each word of each transcript file: path, language, seq, text, s, e, speaker, score, source, backed, local."""
    d = spark.read.schema(TRANSCRIPT).json(path, multiLine=True).select(F.input_file_name().alias("path"), F.coalesce("language", F.lit("")).alias("language"), F.posexplode("words").alias("seq", "w"))
    return d.select("path", "language", "seq", F.coalesce("w.text", F.lit("")).alias("text"), _us(F.col("w.start")).alias("s"), _us(F.col("w.end")).alias("e"), F.coalesce("w.speaker", F.lit("")).alias("speaker"), "w.score", F.coalesce("w.source", F.lit("heard")).alias("source"), "w.backed", "w.local")


def parse_replies(replies: DataFrame, body: str = "reply", letter_s: float = 0.07, least_s: float = 0.3) -> DataFrame:
    """Heard lines of JSON replies; broken ones and those without text or start are dropped, a missing or early end is made from the letters."""
    r = replies.withColumn("__r", F.explode(F.from_json(body, f"array<{REPLY}>", {"mode": "PERMISSIVE"})))
    text = F.trim(F.coalesce(F.col("__r.text"), F.lit("")))
    start, end = F.col("__r.start"), F.col("__r.end")
    own = [c for c in replies.columns if c != body]
    said = F.greatest(F.lit(least_s), F.length(text) * letter_s)
    fixed = F.when(end.isNull() | (end <= start), start + said).otherwise(end)
    return r.where(start.isNotNull() & (start >= 0) & (text != "")).select(*own, _us(start).alias("s"), _us(fixed).alias("e"), F.coalesce(F.col("__r.speaker"), F.lit("")).alias("speaker"), text.alias("text"))


def parse_script(lines: DataFrame, body: str = "line") -> DataFrame:
    """Rows speaker, offset_s, overlap, text of "S +gap: text" and "S -overlap: text" lines; others are dropped."""
    pattern = r"^\s*(\w+)\s+([+-])(\d+(?:\.\d+)?)\s*:\s*(.*\S)\s*\z"
    part = lambda i: F.regexp_extract(body, pattern, i)
    own = [c for c in lines.columns if c != body]
    return lines.where(F.col(body).rlike(pattern)).select(*own, part(1).alias("speaker"), part(3).cast("double").alias("offset_s"), (part(2) == "-").alias("overlap"), part(4).alias("text"))


def unfolded(answers: DataFrame, body: str, field: str) -> DataFrame:
    """answers whose body may be JSON inside a field of its own JSON: the inner one counts."""
    inner = F.get_json_object(body, f"$.{field}")
    return answers.withColumn(body, F.when(F.get_json_object(inner, f"$.{field}").isNotNull(), inner).otherwise(F.col(body)))
