"""The driver's tables as timed text, in Spark and in SQL.

spans/words: events of a user; a word's text is the event's type. cues: turns of a conversation, 70 ms a
character, one after the other. voices: embeddings. lines: documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000
MINUTE = 60_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, id, label, s, e in microseconds; an event lasts its value in minutes."""
    s = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("event_type").alias("label"), s.alias("s"), (s + F.floor(F.col("value") * MINUTE)).cast("long").alias("e"))


SPANS = """spans AS (SELECT user_id AS key, event_id AS id, event_type AS label, epoch_us(ts) AS s,
  epoch_us(ts) + CAST(floor(value * 60000000) AS BIGINT) AS e FROM events)"""


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, number, speaker, text, start_ms, end_ms."""
    t = table(spark, sf_dir, "conversations")
    ms = F.length("text").cast("long") * 70
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum(ms).over(w)
    return t.select(F.col("conv_id").alias("key"), F.col("turn").alias("number"), F.col("role").alias("speaker"), "text", (upto - ms).alias("start_ms"), upto.alias("end_ms"))


CUES = """cues AS (SELECT conv_id AS key, turn AS number, role AS speaker, text,
  CAST(sum(len(text) * 70) OVER w - len(text) * 70 AS BIGINT) AS start_ms, CAST(sum(len(text) * 70) OVER w AS BIGINT) AS end_ms
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, number, source, target: each turn with the next turn of its conversation as its translation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("number"), F.col("text").alias("source"), F.lead("text").over(w).alias("target"))
    return t.where("target is not null")


PAIRS = """pairs AS (SELECT * FROM (SELECT conv_id AS key, turn AS number, text AS source,
  lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS target FROM conversations) WHERE target IS NOT NULL)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, number, text: the lines of documents, from 1."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return d.select("key", (F.col("n") + 1).cast("long").alias("number"), "text")


LINES = """lines AS (SELECT doc_id AS key, CAST(generate_subscripts(parts, 1) AS BIGINT) AS number, unnest(parts) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"""


def voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, vec."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


VOICES = "voices AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"
