"""Quality measures, scores against a truth, and comparisons of bench runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import shapes, text


def timing_stats(rows: DataFrame, keys: Sequence[str], error: str, share: float = 0.95) -> DataFrame:
    """keys, n, matched, middle, p95, over_half, over_long: of errors in seconds; null errors are words that match nothing.

    p95 is the error at the half-even place share * (matched - 1) in their order, found by rank.
    """
    e = F.abs(F.col(error))
    got = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count(error).alias("matched"), F.median(e).alias("middle"), F.count_if(e > 0.5).alias("over_half"), F.count_if(e > 1.5).alias("over_long"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__e"))
    ranked = rows.where(F.col(error).isNotNull()).select(*keys, e.alias("__e")).withColumn("__k", rank)
    at = got.select(*keys, (F.bround(share * (F.col("matched") - 1), 0) + 1).alias("__at"))
    p95 = ranked.join(at, list(keys)).groupBy(*keys).agg(F.max(F.when(F.col("__k") == F.col("__at"), F.col("__e"))).alias("p95"))
    return got.join(p95, list(keys), "left")


def drift_slope(rows: DataFrame, keys: Sequence[str], at: str, error: str, least: int = 3, span: float = 1.0) -> DataFrame:
    """keys, slope: seconds of error gained in a minute, where there are points enough over time enough."""
    got = rows.groupBy(*keys).agg(F.regr_slope(error, at).alias("k"), F.count(error).alias("n"), (F.max(at) - F.min(at)).alias("span"))
    return got.where((F.col("n") >= least) & (F.col("span") >= span)).select(*keys, F.round(F.col("k") * 60, 4).alias("slope"))


def precision_recall(rows: DataFrame, keys: Sequence[str], flagged: str, wrong: str) -> DataFrame:
    """keys, hits, false_alarms, missed, unknown, precision, recall: a null truth is unknown and counts for neither."""
    f, w = F.col(flagged), F.col(wrong)
    got = rows.groupBy(*keys).agg(F.count_if(f & w).alias("hits"), F.count_if(f & ~w).alias("false_alarms"), F.count_if(~f & w).alias("missed"), F.count_if(w.isNull()).alias("unknown"))
    return got.withColumns({"precision": F.round(F.try_divide("hits", F.col("hits") + F.col("false_alarms")), 2), "recall": F.round(F.try_divide("hits", F.col("hits") + F.col("missed")), 2)})


def cue_quality(cues: DataFrame, keys: Sequence[str], rate: float = 5.5) -> DataFrame:
    """keys, cues, words, rushed, short, overlapping, doubled: counts over the cues of a clip."""
    w = Window.partitionBy(*keys).orderBy("number")
    seconds = (F.col("end_ms") - F.col("start_ms")) / 1000
    n = F.size(text.tokens(F.col("text")))
    same = F.coalesce(F.array_join(text.tokens(F.lag("text").over(w)), " ") == F.array_join(text.tokens(F.col("text")), " "), F.lit(False))
    d = cues.select(*keys, n.alias("n"), (n > rate * F.greatest(seconds, F.lit(0.4))).alias("rushed"), (seconds < 0.9).alias("short"), F.coalesce(F.lead("start_ms").over(w) < F.col("end_ms"), F.lit(False)).alias("over"), (same & (n > 0)).alias("doubled"))
    return d.groupBy(*keys).agg(F.count("*").alias("cues"), F.sum("n").alias("words"), F.count_if("rushed").alias("rushed"), F.count_if("short").alias("short"), F.count_if("over").alias("overlapping"), F.count_if("doubled").alias("doubled"))


def bench_compare(a: DataFrame, b: DataFrame, keys: Sequence[str], metrics: dict[str, tuple[int, float]]) -> DataFrame:
    """keys, metric, a, b, verdict: for each metric its direction (1: more is better, -1: less) and its relative band."""
    names = list(metrics)

    def long(df, name):
        return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in names])))

    both = long(a, "a").join(long(b, "b"), [*keys, "metric"], "full_outer")
    direction = F.create_map(*[x for m, (d, _) in metrics.items() for x in (F.lit(m), F.lit(d))])
    band = F.create_map(*[x for m, (_, w) in metrics.items() for x in (F.lit(m), F.lit(w))])
    gain = (F.col("b") - F.col("a")) * F.element_at(direction, F.col("metric"))
    room = F.abs("a") * F.element_at(band, F.col("metric"))
    verdict = F.when(F.col("a").isNull() | F.col("b").isNull(), "missing").when(gain > room, "better").when(gain < -room, "worse").otherwise("same")
    return both.withColumn("verdict", verdict)


def bench_report(rows: DataFrame, by: str, means: Sequence[str], middles: Sequence[str], totals: Sequence[str]) -> DataFrame:
    """One row for each value of by, and one for all."""
    aggs = [F.count("*").alias("n")]
    aggs += [F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in means]
    aggs += [F.median(F.col(c).cast("double")).alias(f"middle_{c}") for c in middles]
    aggs += [F.sum(F.col(c).cast("double")).alias(f"sum_{c}") for c in totals]
    got = rows.rollup(by).agg(F.grouping(by).alias("__all"), *aggs)
    return got.withColumn(by, F.when(F.col("__all") == 1, "all").otherwise(F.col(by))).drop("__all")


def worst(rows: DataFrame, weights: dict[str, float], k: int, id_col: str) -> DataFrame:
    """The k rows with the largest weighted sum of measures: a top-k report."""
    bad = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    return rows.withColumn("badness", F.round(bad, 6)).orderBy(F.desc("badness"), id_col).limit(k)


def accept(measures: DataFrame, rules: DataFrame) -> DataFrame:
    """rules with value and good: each rule bounds one metric of measures (metric, value): at_most, at_least or equals."""
    got = rules.join(measures, "metric", "left")
    ok = F.when(F.col("op") == "at_most", F.col("value") <= F.col("bound")).when(F.col("op") == "at_least", F.col("value") >= F.col("bound")).when(F.col("op") == "equals", F.col("value") == F.col("bound"))
    return got.withColumn("good", F.coalesce(ok, F.lit(False)))


def score_share(words: DataFrame, keys: Sequence[str], score: str, least: float = 0.3) -> DataFrame:
    """keys, share, floor: words found (null scores are left out), and the floor for weak ones: half the median, at most least."""
    got = words.groupBy(*keys).agg(F.avg(F.when(F.col(score).isNotNull(), (F.col(score) >= least).cast("double"))).alias("share"), F.median(score).alias("m"))
    return got.select(*keys, "share", F.least(F.lit(least), 0.5 * F.col("m")).alias("floor"))


def weighted_bar(runs: DataFrame, keys: Sequence[str], score: str, weight: str, least: float = 0.3, part: float = 0.85) -> DataFrame:
    """keys, bar: part of the weighted median score, least at least."""
    return runs.groupBy(*keys).agg(F.greatest(F.lit(least), part * F.percentile(score, 0.5, F.col(weight))).alias("bar"))


def implausible(words: DataFrame, keys: Sequence[str], rate: float = 8.0, least: int = 10) -> DataFrame:
    """keys of clips whose words cannot have been said so: many with hardly any time, or too many a second."""
    seconds = (F.col("e") - F.col("s")) / 1e6
    got = words.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((seconds < 0.02).cast("double")).alias("instant"), ((F.max("e") - F.min("s")) / 1e6).alias("span"))
    return got.where((F.col("n") >= least) & ((F.col("instant") > 0.3) | (F.col("n") > rate * F.col("span")))).select(*keys, "n")


def sane_pass(lines: DataFrame, keys: Sequence[str], seconds: Column, share: float = 0.9) -> DataFrame:
    """Plausible lines of passes that keep at least so much of their words."""
    n = text.counted(F.col("text"))
    d = lines.withColumns({"__n": n, "__ok": shapes.plausible_line(seconds, n)})
    w = Window.partitionBy(*keys)
    kept = F.sum(F.when(F.col("__ok"), F.col("__n"))).over(w)
    return d.withColumn("__share", kept / F.greatest(F.sum("__n").over(w), F.lit(1e-9))).where(F.col("__ok") & (F.col("__share") >= share)).drop("__n", "__ok", "__share")


def doubts(rows: DataFrame, keys: Sequence[str], most: int = 6) -> DataFrame:
    """keys, kind, n, first: counts of each kind of issue, and the numbers of the first few."""
    return rows.groupBy(*keys, "kind").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("number")), 1, most).alias("first"))


def pause_quantiles(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, p50, p80, p95, most: of the pauses between words (id, s, e), in seconds; what overlaps has none."""
    w = Window.partitionBy(*keys).orderBy("s", "e", "id")
    g = words.select(*keys, ((F.col("s") - F.lag("e").over(w)) / 1e6).alias("gap")).where("gap > 0")
    q = F.percentile("gap", F.array(F.lit(0.5), F.lit(0.8), F.lit(0.95)))
    got = g.groupBy(*keys).agg(q.alias("q"), F.max("gap").alias("most"))
    return got.select(*keys, *[F.element_at("q", i).alias(n) for i, n in ((1, "p50"), (2, "p80"), (3, "p95"))], "most")


def readable_pick(streams: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """keys, height, rate, heights: of the streams (height, rate) the tallest up to most, else the lowest; of one height the best rate."""
    best = streams.groupBy(*keys, "height").agg(F.max("rate").alias("rate"))
    fits = F.struct(F.when(F.col("height") <= most, 1).otherwise(0).alias("fits"), F.when(F.col("height") <= most, F.col("height")).otherwise(-F.col("height")).alias("by"))
    return best.groupBy(*keys).agg(F.max_by("height", fits).alias("height"), F.max_by("rate", fits).alias("rate"), F.count("*").alias("heights"))
