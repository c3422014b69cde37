"""Queries on voices, measures, bench runs and settings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import shapes, text
from ..operators import measures as ms
from ..operators import settings as st
from ..operators import voices as vo
from .adapters import HOUR, SPANS, VOICES, spans, table, voices

K = ["key"]


def nearest_voice(spark, sf_dir):
    return vo.nearest(voices(spark, sf_dir)).groupBy("label", "near").agg(F.count("*").alias("n"))


def voice_sums(spark, sf_dir):
    got = vo.sums(voices(spark, sf_dir), ["label"])
    return got.select("label", F.col("n"), F.round(F.aggregate("total", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def leave_one_out(spark, sf_dir):
    got = vo.leave_one_out(voices(spark, sf_dir))
    return got.select("id", F.round("own", 6).alias("own"), F.round("rival", 6).alias("rival"))


def voices_apart(spark, sf_dir):
    return vo.apart(voices(spark, sf_dir)).select("label", "n", F.round("apart", 6).alias("apart"))


def silhouette(spark, sf_dir):
    got = vo.silhouette(voices(spark, sf_dir))
    return got.groupBy("label").agg(F.round(F.avg("silhouette"), 6).alias("silhouette"), F.count("*").alias("n"))


def voice_moves(spark, sf_dir):
    return vo.moved(voices(spark, sf_dir), least=0.3, more=0.1).where("settled <> label").select("id", "label", "settled")


def _moves(d):
    return d.withColumn("settled", F.when(F.col("label") == "error", "view").otherwise(F.col("label")))


def short_follow(spark, sf_dir):
    d = vo.short_follow(_moves(spans(spark, sf_dir)), K, HOUR // 4)
    return d.groupBy("label", "followed").agg(F.count("*").alias("n"))


def timing_stats(spark, sf_dir):
    d = spans(spark, sf_dir).withColumn("error", F.when(F.col("id") % 10 > 0, (F.col("e") - F.col("s")) / 6e7 / 20))
    got = ms.timing_stats(d, ["label"], "error")
    return got.select("label", "n", "matched", F.round("middle", 9).alias("middle"), F.round("p95", 9).alias("p95"), "over_half", "over_long")


def drift_slope(spark, sf_dir):
    d = spans(spark, sf_dir).select("key", (F.col("s") / 6e7 % 1000).alias("at"), ((F.col("e") - F.col("s")) / 6e7).alias("error"))
    return ms.drift_slope(d, K, "at", "error")


def precision_recall(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    flagged, wrong = F.col("n_chars") < 1000, F.col("quality") == 0
    return ms.precision_recall(d.withColumns({"flagged": flagged, "wrong": wrong}), ["lang"], "flagged", "wrong")


def _runs(spark, sf_dir, flag):
    li = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag)
    d = li.withColumn("cell", F.col("l_linenumber"))
    return d.groupBy("cell").agg(F.avg("l_quantity").alias("words"), F.avg("l_discount").alias("lost"), F.count("*").cast("double").alias("rows"))


def bench_compare(spark, sf_dir):
    got = ms.bench_compare(_runs(spark, sf_dir, "A"), _runs(spark, sf_dir, "R"), ["cell"], {"words": (1, 0.005), "lost": (-1, 0.01), "rows": (1, 0.0)})
    return got.select("cell", "metric", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), "verdict")


def bench_report(spark, sf_dir):
    got = ms.bench_report(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_quantity"], ["l_discount"], ["l_extendedprice"])
    return got.select("l_returnflag", "n", F.round("mean_l_quantity", 6).alias("mean_l_quantity"), F.round("middle_l_discount", 6).alias("middle_l_discount"), F.round("sum_l_extendedprice", 2).alias("sum_l_extendedprice"))


def worst_rows(spark, sf_dir):
    d = table(spark, sf_dir, "orders")
    return ms.worst(d, {"o_totalprice": 1.0, "o_custkey": 0.5}, 20, "o_orderkey").select("o_orderkey", "badness")


def acceptance(spark, sf_dir):
    m = ms.bench_report(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_quantity"], [], []).select(F.concat(F.lit("quantity_"), "l_returnflag").alias("metric"), F.round("mean_l_quantity", 6).alias("value"))
    rules = spark.sql("SELECT * FROM VALUES ('quantity_A', 'at_most', 26.0D), ('quantity_R', 'at_least', 30.0D), ('quantity_none', 'equals', 1.0D) AS r(metric, op, bound)")
    return ms.accept(m, rules).select("metric", "op", "value", "good")


def score_share(spark, sf_dir):
    d = spans(spark, sf_dir).withColumn("score", F.when(F.col("id") % 7 > 0, (F.col("e") - F.col("s")) / 6e7 / 100))
    return ms.score_share(d, ["label"], "score").select("label", F.round("share", 9).alias("share"), F.round("floor", 9).alias("floor"))


def weighted_bar(spark, sf_dir):
    d = spans(spark, sf_dir).withColumns({"score": (F.col("id") % 100) / 100.0, "weight": F.length("label").cast("long")})
    return ms.weighted_bar(d, K, "score", "weight").select("key", F.round("bar", 6).alias("bar"))


def implausible_clips(spark, sf_dir):
    d = spans(spark, sf_dir).withColumn("e", F.col("s") + F.floor((F.col("e") - F.col("s")) / 100_000))
    return ms.implausible(d, K)


def off_voice_words(spark, sf_dir):
    """Words more than two hours from any purchase."""
    d = spans(spark, sf_dir)
    got = vo.off_voice(d.withColumn("mark", F.when(F.col("label") == "purchase", "p")), K, "mark", 2 * HOUR)
    return got.groupBy("label").agg(F.count("*").alias("n"))


def label_flips(spark, sf_dir):
    """Changes of label inside a day of a user."""
    d = spans(spark, sf_dir).withColumn("day", F.floor(F.col("s") / (24 * HOUR)))
    was = F.lag("label").over(Window.partitionBy("key", "day").orderBy("s", "e", "id"))
    return d.withColumn("flip", (was != F.col("label")).cast("long")).groupBy("key").agg(F.coalesce(F.sum("flip"), F.lit(0)).alias("flips"))


def letter_gaps(spark, sf_dir):
    """Quantiles of the pauses between a user's events, in seconds."""
    got = ms.pause_quantiles(spans(spark, sf_dir), K)
    return got.select("key", *[F.round(c, 3).alias(c) for c in ("p50", "p80", "p95", "most")])


def settings_gate(spark, sf_dir):
    """Part sizes, brands and containers as raw settings."""
    d = table(spark, sf_dir, "part")
    raw = F.when(F.col("p_partkey") % 5 == 0, F.lit(" ٧٫٥ %")).when(F.col("p_partkey") % 5 == 1, F.lit("loud")).when(F.col("p_partkey") % 5 == 2, F.lit(None)).otherwise(F.col("p_size").cast("string"))
    got = st.number(raw, 2.0, 30.0, 0.5)
    return d.select("p_partkey", got["value"].alias("value"), got["reason"].alias("reason"), got["nearest"].alias("nearest"), st.choice(F.col("p_brand"), ["brand#11", "BRAND#12", "Brand#13"])["value"].alias("brand"))


def colour_contrast(spark, sf_dir):
    d = table(spark, sf_dir, "part").withColumn("c", F.concat(F.lit("#"), F.lpad(F.lower(F.hex((F.col("p_partkey") * 7919) % 16777216)), 6, "0")))
    return d.select("p_partkey", st.colour(F.col("c")).alias("colour"), F.round(shapes.contrast(F.col("c"), F.lit("#000000")), 6).alias("on_black"), shapes.ass_colour(F.col("c"), F.lit(0.5)).alias("ass"))


def quality_catalog(spark, sf_dir):
    """Part sizes as heights: the best of each, and the nearest one up to 25."""
    d = table(spark, sf_dir, "part").select("p_brand", F.col("p_size").alias("height"), F.col("p_retailprice").alias("rate"))
    return ms.readable_pick(d, ["p_brand"], 25).select("p_brand", F.col("height").cast("long").alias("nearest"), "heights")


QUERIES = {f.__name__: f for f in (nearest_voice, voice_sums, leave_one_out, voices_apart, silhouette, voice_moves, short_follow, timing_stats, drift_slope, precision_recall, bench_compare, bench_report, worst_rows, acceptance, score_share, weighted_bar, implausible_clips, off_voice_words, label_flips, letter_gaps, settings_gate, colour_contrast, quality_catalog)}

_SUMS = """x AS (SELECT label, vec, unnest(range(1, 65)) AS i FROM voices), s0 AS (SELECT label, i, sum(vec[i]) AS x, count(*) AS n FROM x GROUP BY label, i),
  sums AS (SELECT label, max(n) AS n, list(x ORDER BY i) AS total FROM s0 GROUP BY label)"""
_LOO = f"""{_SUMS}, loo AS (SELECT v.id, v.label, m.n, CASE WHEN m.n > 1 THEN list_cosine_similarity(list_transform(range(1, 65), lambda i: m.total[i] - v.vec[i]), v.vec) END AS own,
    (SELECT max(list_cosine_similarity(v.vec, o.total)) FROM sums o WHERE o.label <> v.label) AS rival FROM voices v JOIN sums m ON m.label = v.label)"""
_NEAR = f"""{_SUMS}, n AS (SELECT v.id, v.label, s.label AS near, round(list_cosine_similarity(v.vec, s.total), 9) AS sim, row_number() OVER (PARTITION BY v.id ORDER BY round(list_cosine_similarity(v.vec, s.total), 9) DESC, s.label) AS k FROM voices v, sums s)"""
_BENCH = """SELECT l_linenumber AS cell, avg(l_quantity) AS words, avg(l_discount) AS lost, CAST(count(*) AS DOUBLE) AS rows FROM lineitem WHERE l_returnflag = '{f}' GROUP BY 1"""

SQL = {
    "nearest_voice": f"WITH {VOICES}, {_NEAR} SELECT label, near, count(*) AS n FROM n WHERE k = 1 GROUP BY label, near",
    "voice_sums": f"WITH {VOICES}, {_SUMS} SELECT label, n, round(list_sum(total), 6) AS total FROM sums",
    "leave_one_out": f"WITH {VOICES}, {_LOO} SELECT id, round(own, 6) AS own, round(rival, 6) AS rival FROM loo",
    "voices_apart": f"WITH {VOICES}, {_LOO} SELECT label, count(*) AS n, round(avg(own - rival), 6) AS apart FROM loo WHERE own IS NOT NULL AND rival IS NOT NULL GROUP BY label",
    "silhouette": f"""WITH {VOICES}, d AS (SELECT a.id, a.label, b.label AS other, avg(1 - list_cosine_similarity(a.vec, b.vec)) AS d FROM voices a JOIN voices b ON a.id <> b.id GROUP BY ALL),
  s AS (SELECT id, label, min(d) FILTER (other = label) AS a, min(d) FILTER (other <> label) AS b FROM d GROUP BY id, label)
  SELECT label, round(avg((b - a) / greatest(a, b)), 6) AS silhouette, count(*) AS n FROM s GROUP BY label""",
    "voice_moves": f"""WITH {VOICES}, {_NEAR}, {_LOO.split('sums AS')[1].split('GROUP BY label), ')[1]}
  SELECT n.id, n.label, n.near AS settled FROM n JOIN loo USING (id) WHERE n.k = 1 AND n.near <> n.label AND n.sim >= 0.3 AND n.sim - coalesce(loo.own, -1.0) >= 0.1""",
    "short_follow": f"""WITH {SPANS}, m AS (SELECT *, CASE WHEN label = 'error' THEN 'view' ELSE label END AS settled FROM spans),
  w AS (SELECT *, last_value(CASE WHEN e - s >= {HOUR // 4} THEN settled END IGNORE NULLS) OVER (PARTITION BY key, label ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
    first_value(CASE WHEN e - s >= {HOUR // 4} THEN settled END IGNORE NULLS) OVER (PARTITION BY key, label ORDER BY s, e, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM m)
  SELECT label, CASE WHEN coalesce(e - s < {HOUR // 4} AND a = b AND b <> label, false) THEN b ELSE settled END AS followed, count(*) AS n FROM w GROUP BY ALL""",
    "timing_stats": f"""WITH {SPANS}, d AS (SELECT label, CASE WHEN id % 10 > 0 THEN (e - s) / 6e7 / 20 END AS error FROM spans),
  g AS (SELECT label, count(*) AS n, count(error) AS matched, median(error) AS middle, list_sort(list(error) FILTER (error IS NOT NULL)) AS v, count(*) FILTER (error > 0.5) AS over_half, count(*) FILTER (error > 1.5) AS over_long FROM d GROUP BY label)
  SELECT label, n, matched, round(middle, 9) AS middle, round(v[CAST(round_even(0.95 * (len(v) - 1), 0) AS BIGINT) + 1], 9) AS p95, over_half, over_long FROM g""",
    "drift_slope": f"""WITH {SPANS}, d AS (SELECT key, (s / 6e7) % 1000 AS at_, (e - s) / 6e7 AS error FROM spans)
  SELECT key, round(regr_slope(error, at_) * 60, 4) AS slope FROM d GROUP BY key HAVING count(error) >= 3 AND max(at_) - min(at_) >= 1""",
    "precision_recall": """WITH d AS (SELECT lang, n_chars < 1000 AS f, quality = 0 AS w FROM documents LEFT JOIN labels USING (doc_id)),
  g AS (SELECT lang, count(*) FILTER (f AND w) AS hits, count(*) FILTER (f AND NOT w) AS false_alarms, count(*) FILTER (NOT f AND w) AS missed, count(*) FILTER (w IS NULL) AS unknown FROM d GROUP BY lang)
  SELECT *, round(hits / nullif(hits + false_alarms, 0), 2) AS precision, round(hits / nullif(hits + missed, 0), 2) AS recall FROM g""",
    "bench_compare": f"""WITH a AS ({_BENCH.format(f='A')}), b AS ({_BENCH.format(f='R')}), la AS (UNPIVOT a ON words, lost, rows INTO NAME metric VALUE a), lb AS (UNPIVOT b ON words, lost, rows INTO NAME metric VALUE b),
  j AS (SELECT coalesce(la.cell, lb.cell) AS cell, coalesce(la.metric, lb.metric) AS metric, la.a, lb.b FROM la FULL JOIN lb ON la.cell = lb.cell AND la.metric = lb.metric),
  g AS (SELECT *, (b - a) * CASE metric WHEN 'lost' THEN -1 ELSE 1 END AS gain, abs(a) * CASE metric WHEN 'words' THEN 0.005 WHEN 'lost' THEN 0.01 ELSE 0.0 END AS room FROM j)
  SELECT cell, metric, round(a, 6) AS a, round(b, 6) AS b, CASE WHEN a IS NULL OR b IS NULL THEN 'missing' WHEN gain > room THEN 'better' WHEN gain < -room THEN 'worse' ELSE 'same' END AS verdict FROM g""",
    "bench_report": """SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'all' ELSE l_returnflag END AS l_returnflag, count(*) AS n, round(avg(CAST(l_quantity AS DOUBLE)), 6) AS mean_l_quantity, round(median(CAST(l_discount AS DOUBLE)), 6) AS middle_l_discount, round(sum(CAST(l_extendedprice AS DOUBLE)), 2) AS sum_l_extendedprice
  FROM lineitem GROUP BY ROLLUP (lineitem.l_returnflag)""",
    "worst_rows": "SELECT o_orderkey, round(CAST(o_totalprice AS DOUBLE) + 0.5 * o_custkey, 6) AS badness FROM orders ORDER BY badness DESC, o_orderkey LIMIT 20",
    "acceptance": """WITH m AS (SELECT 'quantity_' || CASE WHEN grouping(l_returnflag) = 1 THEN 'all' ELSE l_returnflag END AS metric, round(avg(CAST(l_quantity AS DOUBLE)), 6) AS value FROM lineitem GROUP BY ROLLUP (l_returnflag)),
  r(metric, op, bound) AS (VALUES ('quantity_A', 'at_most', 26.0), ('quantity_R', 'at_least', 30.0), ('quantity_none', 'equals', 1.0))
  SELECT metric, op, value, coalesce(CASE op WHEN 'at_most' THEN value <= bound WHEN 'at_least' THEN value >= bound ELSE value = bound END, false) AS good FROM r LEFT JOIN m USING (metric)""",
    "score_share": f"""WITH {SPANS}, d AS (SELECT label, CASE WHEN id % 7 > 0 THEN (e - s) / 6e7 / 100 END AS score FROM spans)
  SELECT label, round(avg(CASE WHEN score >= 0.3 THEN 1.0 WHEN score IS NOT NULL THEN 0.0 END), 9) AS share, round(least(0.3, 0.5 * median(score)), 9) AS floor FROM d GROUP BY label""",
    "implausible_clips": f"""WITH {SPANS}, d AS (SELECT key, s, s + (e - s) // 100000 AS e FROM spans)
  SELECT key, count(*) AS n FROM d GROUP BY key HAVING count(*) >= 10 AND (avg(CASE WHEN (e - s) / 1e6 < 0.02 THEN 1.0 ELSE 0.0 END) > 0.3 OR count(*) > 8 * (max(e) - min(s)) / 1e6)""",
    "off_voice_words": f"""WITH {SPANS}, w AS (SELECT *, last_value(CASE WHEN label = 'purchase' THEN e END IGNORE NULLS) OVER v AS b, first_value(CASE WHEN label = 'purchase' THEN s END IGNORE NULLS) OVER u AS a FROM spans
    WINDOW v AS (PARTITION BY key ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), u AS (PARTITION BY key ORDER BY s, e, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
  SELECT label, count(*) AS n FROM w WHERE label <> 'purchase' AND (b IS NULL OR greatest(s - b, 0) > {2 * HOUR}) AND (a IS NULL OR greatest(a - e, 0) > {2 * HOUR}) GROUP BY label""",
    "label_flips": f"""WITH {SPANS}, d AS (SELECT key, label <> lag(label) OVER (PARTITION BY key, s // {24 * HOUR} ORDER BY s, e, id) AS flip FROM spans) SELECT key, count(*) FILTER (flip) AS flips FROM d GROUP BY key""",
    "letter_gaps": f"""WITH {SPANS}, g AS (SELECT key, (s - lag(e) OVER (PARTITION BY key ORDER BY s, e, id)) / 1e6 AS gap FROM spans)
  SELECT key, round(quantile_cont(gap, 0.5), 3) AS p50, round(quantile_cont(gap, 0.8), 3) AS p80, round(quantile_cont(gap, 0.95), 3) AS p95, round(max(gap), 3) AS most FROM g WHERE gap > 0 GROUP BY key""",
    "settings_gate": f"""WITH d AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 5 = 0 THEN ' ٧٫٥ %' WHEN p_partkey % 5 = 1 THEN 'loud' WHEN p_partkey % 5 = 2 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS raw FROM part),
  n AS (SELECT *, TRY_CAST(regexp_replace(replace(translate(trim(raw), '{text.EASTERN}', '{text.WESTERN}'), '٫', '.'), '\\s*[%٪]$', '') AS DOUBLE) AS n FROM d),
  o AS (SELECT *, round(2.0 + round_even((least(greatest(n, 2.0), 30.0) - 2.0) / 0.5, 0) * 0.5, 4) AS on_step FROM n),
  r AS (SELECT *, CASE WHEN raw IS NULL OR trim(raw) = '' THEN 'missing' WHEN n IS NULL THEN 'not a number' WHEN n < 2.0 THEN 'too small' WHEN n > 30.0 THEN 'too large' WHEN abs(n - on_step) > 1e-6 THEN 'off the step' END AS reason FROM o)
  SELECT p_partkey, CASE WHEN reason IS NULL THEN on_step END AS value, reason, CASE WHEN n IS NOT NULL AND reason IS NOT NULL THEN on_step END AS nearest,
    CASE lower(p_brand) WHEN 'brand#11' THEN 0.0::DOUBLE WHEN 'brand#12' THEN 1.0 WHEN 'brand#13' THEN 2.0 END AS brand FROM r""",
    "quality_catalog": """WITH h AS (SELECT p_brand, p_size, max(p_retailprice) AS best FROM part GROUP BY ALL)
  SELECT p_brand, CAST(coalesce(max(p_size) FILTER (p_size <= 25), min(p_size)) AS BIGINT) AS nearest, count(*) AS heights FROM h GROUP BY p_brand""",
    "colour_contrast": """WITH c AS (SELECT p_partkey, '#' || lpad(lower(to_hex((p_partkey * 7919) % 16777216)), 6, '0') AS c FROM part),
  v AS (SELECT *, list_transform([2, 4, 6], lambda i: CAST(('0x' || c[i:i+1]) AS INTEGER) / 255) AS p FROM c),
  l AS (SELECT *, list_transform(p, lambda x: CASE WHEN x <= 0.04045 THEN x / 12.92 ELSE pow((x + 0.055) / 1.055, 2.4) END) AS q FROM v)
  SELECT p_partkey, c AS colour, round((0.2126 * q[1] + 0.7152 * q[2] + 0.0722 * q[3] + 0.05) / 0.05, 6) AS on_black, upper('&H80' || c[6:7] || c[4:5] || c[2:3]) AS ass FROM l""",
}
SQL["weighted_bar"] = f"""WITH {SPANS}, d AS (SELECT key, (id % 100) / 100.0 AS score, unnest(range(len(label))) FROM spans) SELECT key, round(greatest(0.3, 0.85 * median(score)), 6) AS bar FROM d GROUP BY key"""
