"""Rows for the edge cases that every operator has to stand."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(20_000))

#: Null in each column, empty and white-space texts, ties, repeated rows, a very long text.
EDGES = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \t\n ", None, "a", 4),
    (4, "one two", "en", None, 7),
    (5, "one two", "en", "b", 7),
    (6, "same five words stand here always", "en", "b", None),
    (6, "same five words stand here always", "en", "b", None),
    (None, "a row without any id at all", "en", "b", 27),
    (None, None, None, None, None),
    (7, LONG, "en", "c", len(LONG)),
    (8, "é ü 你好 \U0001f600 mixed", "fr", "c", 15),
]


def edges(spark, **extra: str):
    """The edge rows, with further columns whose names may clash with results."""
    d = spark.createDataFrame(EDGES, DOCS)
    from pyspark.sql import functions as F

    for name, value in extra.items():
        d = d.withColumn(name, F.lit(value))
    return d


def empty(spark):
    return spark.createDataFrame([], DOCS)


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice("thern ontio eating blend shore worth inter ander olive quick mouse tower field grape".split()) + r.choice(["", "s", "ed", "ly", str(r.randrange(100))]) for _ in range(words))
