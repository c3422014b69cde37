"""The language dimension: direction, line length, reading speed, and whether words are spaced."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code, name, right to left, characters of a line, characters read in a second, words spaced.
LANGUAGES = [
    ("ar", "Arabic", True, 42, 17.0, True),
    ("en", "English", False, 42, 17.0, True),
    ("fr", "French", False, 42, 17.0, True),
    ("es", "Spanish", False, 42, 17.0, True),
    ("de", "German", False, 42, 17.0, True),
    ("it", "Italian", False, 42, 17.0, True),
    ("pt", "Portuguese", False, 42, 17.0, True),
    ("nl", "Dutch", False, 42, 17.0, True),
    ("sv", "Swedish", False, 42, 17.0, True),
    ("pl", "Polish", False, 42, 17.0, True),
    ("cs", "Czech", False, 42, 17.0, True),
    ("ro", "Romanian", False, 42, 17.0, True),
    ("hu", "Hungarian", False, 42, 17.0, True),
    ("el", "Greek", False, 42, 17.0, True),
    ("ru", "Russian", False, 42, 17.0, True),
    ("uk", "Ukrainian", False, 42, 17.0, True),
    ("tr", "Turkish", False, 42, 17.0, True),
    ("fa", "Persian", True, 42, 17.0, True),
    ("ur", "Urdu", True, 42, 17.0, True),
    ("he", "Hebrew", True, 42, 17.0, True),
    ("hi", "Hindi", False, 42, 17.0, True),
    ("bn", "Bengali", False, 42, 17.0, True),
    ("ta", "Tamil", False, 42, 17.0, True),
    ("id", "Indonesian", False, 42, 17.0, True),
    ("ms", "Malay", False, 42, 17.0, True),
    ("tl", "Filipino", False, 42, 17.0, True),
    ("vi", "Vietnamese", False, 42, 17.0, True),
    ("th", "Thai", False, 35, 15.0, False),
    ("sw", "Swahili", False, 42, 17.0, True),
    ("am", "Amharic", False, 42, 17.0, True),
    ("zh", "Chinese (Simplified)", False, 16, 9.0, False),
    ("zh-TW", "Chinese (Traditional)", False, 16, 9.0, False),
    ("ja", "Japanese", False, 13, 4.0, False),
    ("ko", "Korean", False, 16, 12.0, True),
]


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LANGUAGES, "code string, name string, rtl boolean, line_chars int, cps double, spaced boolean")


def with_language(df: DataFrame, code: str) -> DataFrame:
    """df with name, rtl, line_chars, cps, spaced of its language; an unknown code is its own name with the usual values."""
    dim = languages(df.sparkSession).withColumnRenamed("code", "__code")
    d = df.join(dim, F.col(code) == F.col("__code"), "left").drop("__code")
    usual = {"name": F.col(code), "rtl": F.lit(False), "line_chars": F.lit(42), "cps": F.lit(17.0), "spaced": F.lit(True)}
    return d.withColumns({c: F.coalesce(c, v) for c, v in usual.items()})
