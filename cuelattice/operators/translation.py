"""Checks of translations against their sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def lost_numbers(pairs: DataFrame) -> DataFrame:
    """The pairs with lost: numbers of the source that the target lacks; pairs that lose none are left out."""
    return pairs.withColumn("lost", F.array_sort(F.array_except(text.numbers(F.col("source")), text.numbers(F.col("target"))))).where(F.size("lost") > 0)


def echoes(pairs: DataFrame, keys: Sequence[str], share: float = 0.5, least: int = 3) -> DataFrame:
    """Pairs whose target says the source again, where fewer than the share of the clip's longer lines do."""
    src, dst = text.tokens(F.col("source")), text.tokens(F.col("target"))
    d = pairs.withColumn("__long", F.size(src) >= least).withColumn("echo", F.col("__long") & (F.array_join(src, " ") == F.array_join(dst, " ")))
    w = Window.partitionBy(*keys)
    part = F.sum(F.col("echo").cast("long")).over(w) / F.greatest(F.sum(F.col("__long").cast("long")).over(w), F.lit(1))
    return d.withColumn("__part", part).where(F.col("echo") & (F.col("__part") < share)).drop("__long", "__part", "echo")


def shortened(pairs: DataFrame, keys: Sequence[str], share: float = 0.4, tokens: int = 6, lines: int = 5) -> DataFrame:
    """Pairs much shorter than their clip's usual ratio of target to source letters; lines left as said count for neither."""
    src = text.tokens(F.col("source"))
    d = pairs.where((F.size(src) >= tokens) & (src != text.tokens(F.col("target"))))
    d = d.withColumn("ratio", text.letters(F.col("target")) / F.greatest(text.letters(F.col("source")), F.lit(1)))
    usual = d.groupBy(*keys).agg(F.median("ratio").alias("usual"), F.count("*").alias("n")).where(F.col("n") >= lines)
    return d.join(usual, list(keys)).where(F.col("ratio") < share * F.col("usual")).drop("n")


def slide(pairs: DataFrame, keys: Sequence[str], least: int = 8, low: float = 0.3, more: float = 0.25) -> DataFrame:
    """keys, n, straight, shifted, slid: correlation of lengths line by line, and with the target one line on.

    Constant lengths correlate with nothing: 0.
    """
    w = Window.partitionBy(*keys).orderBy("number")
    a, b = F.length("source").cast("double"), F.length("target").cast("double")
    d = pairs.select(*keys, "number", a.alias("a"), b.alias("b"), F.lead(b).over(w).alias("c"))

    def corr(x, y):
        good = (F.stddev_pop(F.when(F.col(y).isNotNull(), F.col(x))) > 0) & (F.stddev_pop(y) > 0)
        cov = F.covar_pop(x, y)
        return F.when(good, cov / F.greatest(F.stddev_pop(F.when(F.col(y).isNotNull(), F.col(x))) * F.stddev_pop(y), F.lit(1e-300))).otherwise(0.0)

    got = d.groupBy(*keys).agg(F.count("*").alias("n"), F.round(corr("a", "b"), 4).alias("straight"), F.round(corr("a", "c"), 4).alias("shifted")).where(F.col("n") >= least)
    return got.withColumn("slid", (F.col("straight") < low) & (F.col("shifted") - F.col("straight") > more))


def slid_windows(pairs: DataFrame, keys: Sequence[str], width: int = 12, hop: int = 6) -> DataFrame:
    """keys, window, n, straight, shifted, slid: slide() over windows of lines."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("number")) - 1
    d = pairs.withColumn("__i", place)
    lo = F.greatest(F.lit(0), F.floor((F.col("__i") - width) / hop) + 1)
    d = d.withColumn("window", F.explode(F.sequence(lo.cast("int"), F.floor(F.col("__i") / hop).cast("int")))).drop("__i")
    return slide(d, [*keys, "window"], least=8, low=0.45, more=0.15)


def misnamed(pairs: DataFrame, glossary: DataFrame) -> DataFrame:
    """pairs with term: glossary terms that the source holds as a word, without their meaning in the target.

    The glossary is a list of at most 50 entries; its terms meet the texts by their first word, not by a
    comparison of each with each.
    """
    g = glossary.withColumn("__first", F.element_at(text.tokens(F.col("term")), 1)).where("__first is not null")
    d = pairs.withColumn("__first", F.explode(F.array_distinct(text.tokens(F.col("source")))))
    both = d.join(g, "__first")
    padded = lambda c: F.concat(F.lit(" "), F.array_join(text.tokens(F.col(c)), " "), F.lit(" "))
    said = F.contains(padded("source"), padded("term"))
    meant = F.contains(F.lower("target"), F.lower("meaning"))
    return both.where(said & ~meant).drop("__first")


def unfaithful(pairs: DataFrame, keys: Sequence[str], glossary: DataFrame) -> DataFrame:
    """keys, number, kinds: lines whose translation fails a check, and which; lines without one are left out."""
    written = pairs.where(F.trim(F.coalesce("target", F.lit(""))) != "")
    found = None
    for kind, part in (("number", lost_numbers(written)), ("glossary", misnamed(written, glossary)), ("echo", echoes(written, keys)), ("short", shortened(written, keys))):
        part = part.select(*keys, "number", F.lit(kind).alias("kind"))
        found = part if found is None else found.unionByName(part)
    return found.groupBy(*keys, "number").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def context(pairs: DataFrame, keys: Sequence[str], side: int = 3) -> DataFrame:
    """pairs with around: the sources of up to side neighbours on either side, in order."""
    w = Window.partitionBy(*keys).orderBy("number")
    before, after = F.collect_list("source").over(w.rowsBetween(-side, -1)), F.collect_list("source").over(w.rowsBetween(1, side))
    return pairs.withColumn("around", F.concat(before, after))


def accepted(pairs: DataFrame, speakers: str) -> DataFrame:
    """pairs with accepted: the target, if its parts fit the speakers; joined for one speaker; empty if they do not fit.

    speakers is an array column with the speaker of each part of the source.
    """
    parts = F.transform(F.split("target", r"\|\|"), lambda p: F.trim(p))
    said = F.transform(F.split("source", r"\|\|"), lambda p: F.trim(p))
    missing = F.exists(F.zip_with(said, parts, lambda s, t: (s != "") & (F.coalesce(t, F.lit("")) == "")), lambda x: x)
    fits = (F.size(parts) == F.size(speakers)) & ~missing
    alone = F.size(F.array_distinct(F.col(speakers))) == 1
    joined = F.array_join(F.filter(parts, lambda p: p != ""), " ")
    return pairs.withColumn("accepted", F.when(alone, joined).when(fits, F.array_join(parts, " || ")).otherwise(""))


def rounds(cues: DataFrame, engines: Sequence[str]) -> DataFrame:
    """cues with text and engine: the first engine's answer that is not empty, else the source."""
    full = [F.when(F.trim(F.coalesce(F.col(e), F.lit(""))) != "", F.col(e)) for e in engines]
    who = F.coalesce(*[F.when(c.isNotNull(), F.lit(e)) for c, e in zip(full, engines, strict=True)], F.lit("source"))
    return cues.withColumns({"text": F.coalesce(*full, F.col("source")), "engine": who})


def needs_retry(cues: DataFrame) -> DataFrame:
    """Cues without a translation whose source has letters and is more than a sound."""
    return cues.where((F.trim(F.coalesce("text", F.lit(""))) == "") & text.has_letters(F.col("source")) & ~text.only_a_sound(F.col("source")))
