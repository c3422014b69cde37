"""Runs of words: islands by pause, label and length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ordered(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("s", "e", "id")


def number_runs(df: DataFrame, keys: Sequence[str], starts: Column, name: str = "run") -> DataFrame:
    """df with the number of its run, from 1; starts says where a new one begins (null: it doesn't)."""
    w = _ordered(keys)
    first = F.row_number().over(w) == 1
    d = df.withColumn("__start", F.when(first | F.coalesce(starts, F.lit(False)), 1).otherwise(0))
    return d.withColumn(name, F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__start")


def pause(keys: Sequence[str]) -> Column:
    """The time from the end of the row before to this one's start."""
    return F.col("s") - F.lag("e").over(_ordered(keys))


def label_changes(keys: Sequence[str], label: str = "label") -> Column:
    return ~F.col(label).eqNullSafe(F.lag(label).over(_ordered(keys)))


def breath_runs(df: DataFrame, keys: Sequence[str], gap: int, most: int, label: str = "label") -> DataFrame:
    """df with run: a pause longer than gap, another label, or most words before it start a new one."""
    d = number_runs(df, keys, (pause(keys) > gap) | label_changes(keys, label), "__island")
    place = F.row_number().over(Window.partitionBy(*keys, "__island").orderBy("s", "e", "id")) - 1
    d = d.withColumn("__part", F.floor(place / most))
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy("__island", "__part"))
    return d.withColumn("run", rank.cast("long")).drop("__island", "__part")


def speaker_lines(df: DataFrame, keys: Sequence[str], gap: int, label: str = "label") -> DataFrame:
    """keys, line, label, s, e, words: a new line on another speaker or a pause longer than gap."""
    d = number_runs(df, keys, (pause(keys) > gap) | label_changes(keys, label), "line")
    return d.groupBy(*keys, "line").agg(F.first(label, ignorenulls=True).alias("label"), F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("words"))


def unshown_stretches(df: DataFrame, keys: Sequence[str], gap: int, least: int) -> DataFrame:
    """keys, stretch, s, e, words: stretches with pauses below gap and at least so many words."""
    d = number_runs(df, keys, pause(keys) >= gap, "stretch")
    return d.groupBy(*keys, "stretch").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("words")).where(F.col("words") >= least)


def piles(df: DataFrame, keys: Sequence[str], close: int, least: int, squeezed: Column) -> DataFrame:
    """keys, pile, s, e, words, core: words whose ends stand less than close apart, at least so many, with the squeezed words around them."""
    w = _ordered(keys)
    near = F.col("e") - F.lag("e").over(w) < close
    d = number_runs(df, keys, ~near, "__run")
    size = F.count("*").over(Window.partitionBy(*keys, "__run"))
    d = d.withColumn("__core", size >= least).withColumn("__in", F.col("__core") | squeezed)
    before = F.lag("__in").over(w)
    d = number_runs(d, keys, F.col("__in") & ~F.coalesce(before, F.lit(False)), "pile").where("__in")
    got = d.groupBy(*keys, "pile").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("words"), F.sum(F.col("__core").cast("long")).alias("core"))
    return got.where("core > 0")


def turn_runs(df: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """df (in the order of id) with turn: a new one on another speaker or where time goes back."""
    w = Window.partitionBy(*keys).orderBy("id")
    fresh = ~F.col(label).eqNullSafe(F.lag(label).over(w)) | (F.col("s") < F.lag("s").over(w))
    d = df.withColumn("__start", F.when((F.row_number().over(w) == 1) | fresh, 1).otherwise(0))
    return d.withColumn("turn", F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__start")


def blocks(df: DataFrame, keys: Sequence[str], gap: int, ends_sentence: Column, label: str = "label") -> DataFrame:
    """df with block: broken at a sentence's end, a pause of at least gap, another speaker, or where time goes back."""
    w = _ordered(keys)
    ended = F.lag(ends_sentence).over(w)
    return number_runs(df, keys, ended | (pause(keys) >= gap) | label_changes(keys, label), "block")


def level_runs(df: DataFrame, keys: Sequence[str], gap: int, value: str) -> DataFrame:
    """df with level: the largest value of each run of rows at most gap apart."""
    d = number_runs(df, keys, pause(keys) > gap, "__run")
    return d.withColumn("level", F.max(value).over(Window.partitionBy(*keys, "__run"))).drop("__run")


def change_points(df: DataFrame, keys: Sequence[str], side: int, least: int, label: str = "label") -> DataFrame:
    """df with strength where the label changes: rows of the majority on both sides, if each side's edge holds a strict majority of it."""
    w = _ordered(keys)
    before, after = w.rowsBetween(-side, -1), w.rowsBetween(0, side - 1)
    last, here = F.lag(label).over(w), F.col(label)
    d = df.withColumns({"__last": last, "__b": F.collect_list(label).over(before), "__a": F.collect_list(label).over(after)})
    same_b = F.size(F.filter("__b", lambda x: x == F.col("__last")))
    same_a = F.size(F.filter("__a", lambda x: x == here))
    good = (here != F.col("__last")) & (F.size("__b") >= least) & (F.size("__a") >= least) & (2 * same_b > F.size("__b")) & (2 * same_a > F.size("__a"))
    return d.withColumn("strength", F.when(good, (same_a + same_b).cast("long"))).drop("__last", "__b", "__a")


def held_in_place(df: DataFrame, keys: Sequence[str], kept: str, gap: int) -> DataFrame:
    """df with held: dropped rows between two kept ones that are at most gap apart."""
    w = _ordered(keys)
    before = F.last(F.when(F.col(kept), F.col("e")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(F.when(F.col(kept), F.col("s")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return df.withColumn("held", ~F.col(kept) & F.coalesce(after - before <= gap, F.lit(False)))


def spread_evenly(df: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """df with at, until: the key's span shared out among its rows by weight, in order."""
    w = _ordered(keys)
    everything = Window.partitionBy(*keys)
    total = F.sum(weight).over(everything)
    upto = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0))
    low, high = F.min("s").over(everything), F.max("e").over(everything)
    place = lambda part: F.when(total > 0, low + F.floor((high - low) * part / total)).otherwise(low).cast("long")
    return df.withColumns({"at": place(upto - F.col(weight)), "until": place(upto)})
