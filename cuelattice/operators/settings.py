"""Typed settings: raw values become typed ones or are refused with a reason and the nearest value that holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Words for switches.
ON, OFF = ["1", "on", "true", "yes"], ["0", "off", "false", "no"]


def _outcome(value: Column, reason: Column, nearest: Column) -> Column:
    return F.struct(value.alias("value"), reason.alias("reason"), nearest.alias("nearest"))


def number(raw: Column, low: float, high: float, step: float) -> Column:
    """A number in range and on a step, percent signs and eastern digits accepted; else refused with the nearest."""
    clean = F.regexp_replace(F.replace(text.western_digits(F.trim(raw)), F.lit("٫"), F.lit(".")), r"\s*[%٪]\z", "")
    n = clean.try_cast("double")
    inside = F.least(F.greatest(n, F.lit(low)), F.lit(high))
    on = F.round(F.lit(low) + F.bround((inside - low) / step, 0) * step, 4)
    reason = (
        F.when(raw.isNull() | (F.trim(raw) == ""), "missing")
        .when(n.isNull() | F.isnan(n), "not a number")
        .when(n < low, "too small")
        .when(n > high, "too large")
        .when(F.abs(n - on) > 1e-6, "off the step")
    )
    return _outcome(F.when(reason.isNull(), on), reason, F.when(n.isNotNull() & ~F.isnan(n) & reason.isNotNull(), on))


def switch(raw: Column) -> Column:
    word = F.lower(F.trim(raw))
    value = F.when(word.isin(*ON), 1.0).when(word.isin(*OFF), 0.0)
    return _outcome(value, F.when(value.isNull(), "neither on nor off"), F.lit(None).cast("double"))


def choice(raw: Column, options: Sequence[str]) -> Column:
    """The place of the option, whatever its case, from 0."""
    at = F.array_position(F.array(*[F.lit(o.lower()) for o in options]), F.lower(F.trim(raw)))
    return _outcome(F.when(at > 0, (at - 1).cast("double")), F.when(F.coalesce(at, F.lit(0)) == 0, "no such choice"), F.lit(None).cast("double"))


def colour(raw: Column) -> Column:
    """#rgb or #rrggbb as #rrggbb; null if it is neither."""
    c = F.lower(F.trim(raw))
    long = F.concat(F.lit("#"), *[F.repeat(F.substring(c, i, 1), 2) for i in (2, 3, 4)])
    return F.when(c.rlike(r"^#[0-9a-f]{6}\z"), c).when(c.rlike(r"^#[0-9a-f]{3}\z"), long)


def resolve(stored: DataFrame, defaults: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, name, value: every setting, from the stored ones over the defaults."""
    owners = stored.select(*keys).distinct()
    every = owners.crossJoin(defaults.withColumnRenamed("value", "__default"))
    return every.join(stored, [*keys, "name"], "left").select(*keys, "name", F.coalesce("value", "__default").alias("value"))


def snapshot(values: DataFrame, defaults: DataFrame) -> DataFrame:
    """The values that differ from their default."""
    d = defaults.withColumnRenamed("value", "__default")
    return values.join(d, "name").where(~F.col("value").eqNullSafe(F.col("__default"))).drop("__default")


def nearest_holding(values: DataFrame, candidates: DataFrame, holds: Column) -> DataFrame:
    """values (id, value) with nearest: of the candidates that hold the one closest to the value, of equals the smaller.

    candidates is a setting's list of steps: a row for each, a few dozen at most.
    """
    steps = candidates.where(holds).agg(F.sort_array(F.collect_set("candidate")).alias("__c"))
    best = F.array_min(F.transform("__c", lambda c: F.struct(F.abs(c - F.col("value")).alias("d"), c.alias("c"))))["c"]
    return values.crossJoin(steps).withColumn("nearest", best).drop("__c")
