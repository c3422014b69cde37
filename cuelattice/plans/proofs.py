"""Queries on evidence: repeats, cover, homes, budgets, bands, tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.languages import LANGUAGES, with_language
from ..operators import evidence as ev
from ..operators import repair as rp
from .adapters import CUES, HOUR, LINES, SPANS, cues, lines, spans, table
from .dialogue import _tokens

K = ["key"]
DAY = 24 * HOUR


def _timed_lines(spark, sf_dir):
    """Lines of documents, a second each, one after the other."""
    return lines(spark, sf_dir).select("key", F.col("number").alias("line"), (F.col("number") * 1_000_000).alias("s"), (F.col("number") * 1_000_000 + 900_000).alias("e"), "text")


def lines_said_before(spark, sf_dir):
    got = ev.said_before(_timed_lines(spark, sf_dir), K, 3_000_000)
    return got.groupBy("key").agg(F.count_if("old").alias("old"), F.count("*").alias("n"))


def timed_over(spark, sf_dir):
    d = spans(spark, sf_dir)
    mine = d.where("label = 'view'").withColumnRenamed("id", "line").select("key", "line", "s", "e")
    return ev.timed_over(mine, d.where("label <> 'view'"), K, 6 * HOUR).where("over").select("key", "line")


def sentence_home(spark, sf_dir):
    d = spans(spark, sf_dir)
    s = d.where("label in ('purchase', 'error')").select("key", F.col("id").alias("line"), "s", "e", F.lit("view").alias("label"))
    got = ev.sentence_home(d.where("label in ('view', 'click')"), s, K)
    return got.select("id", "home")


def missing_words(spark, sf_dir):
    """Words of conversations shown in cues that stand half a minute later."""
    c = cues(spark, sf_dir)
    w = c.withColumn("t", text.tokens(F.col("text"))).select("key", "number", F.posexplode("t").alias("at", "token"), "start_ms", "end_ms")
    w = w.select("key", (F.col("number") * 100_000 + F.col("at")).alias("id"), "token", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    shown = c.select("key", (F.col("start_ms") + 30_000).alias("s"), (F.col("end_ms") + 30_000).alias("e"), "text")
    got = ev.missing_words(w, shown, K, 300, 60_000)
    return got.groupBy("key").agg(F.count("*").alias("missing"))


def contract_recall(spark, sf_dir):
    d = spans(spark, sf_dir)
    return ev.contract_recall(d.where("label = 'click'").drop("label"), d.where("label = 'error'").drop("label"), K, 6 * HOUR)


def ask_budget(spark, sf_dir):
    d = spans(spark, sf_dir).withColumn("cost", F.col("e") - F.col("s"))
    got = ev.within_budget(d, K, 9, "cost", 6 * HOUR)
    return got.groupBy("key").agg(F.count_if("allowed").alias("allowed"), F.sum(F.when(F.col("allowed"), F.col("cost")).otherwise(0)).alias("us"))


def densest_sample(spark, sf_dir):
    d = spans(spark, sf_dir).withColumn("words", F.length("label"))
    return ev.densest(d, K, DAY, 3)


def text_bands(spark, sf_dir):
    """Picture rows made of events: a user's events are frames, rows those near the event's id."""
    d = spans(spark, sf_dir).select("key", F.col("id").alias("frame"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("row"))
    got = ev.text_bands(d.withColumn("is_text", (F.col("frame") * 7 + F.col("row")) % 40 < 12 + F.col("row") / 8), K, 40, 0.35)
    return got.select("key", F.round("top", 6).alias("top"), F.round("bottom", 6).alias("bottom"))


def placement(spark, sf_dir):
    """Margins that clear the bands of a picture 1080 rows high."""
    d = spans(spark, sf_dir).groupBy("key").agg(F.collect_list(F.struct(((F.col("id") % 90) / 100).alias("top"), ((F.col("id") % 90 + 6) / 100).alias("bottom"))).alias("bands"))
    return d.select("key", ev.clear_bottom(F.col("bands"), 1080, 60, 120, 20).alias("margin"))


def voices_told_apart(spark, sf_dir):
    return ev.told_apart(spans(spark, sf_dir), K, 5 * DAY)


def speech_tiers(spark, sf_dir):
    d = spans(spark, sf_dir).select("key", F.col("id").alias("frame"), ((F.col("id") * 37 % 100) / 100.0).alias("mass"), (F.col("label") == "view").alias("vad"))
    return ev.speech_tiers(d, K).groupBy("key").agg(F.count_if("speech").alias("speech"), F.round(F.max("tau"), 6).alias("tau"))


def segment_homes(spark, sf_dir):
    d = spans(spark, sf_dir)
    cuts = d.where("label = 'purchase'").select("key", F.col("s").alias("at"))
    return ev.segment_homes(d.where("label <> 'purchase'"), cuts, K).select("id", "segment")


def drift_anchor(spark, sf_dir):
    d = spans(spark, sf_dir).select("key", (F.floor(F.col("id") / 500)).alias("line"), F.col("id").alias("seq"), F.when(F.col("label") != "error", F.col("e") - F.col("s")).alias("delta"))
    return ev.drift(d, K, move_us=HOUR // 4)


def similar_lines(spark, sf_dir):
    d = _timed_lines(spark, sf_dir)
    return ev.similar_lines(d, d.withColumn("text", F.concat("text", F.lit(" end"))), K, 1_000_000, 0.8)


def newest_events(spark, sf_dir):
    return ev.latest(spans(spark, sf_dir), K, "s", 5).select("key", "id")


def language_dimension(spark, sf_dir):
    """Documents by the line length and reading speed of their language."""
    d = with_language(table(spark, sf_dir, "documents"), "lang")
    return d.groupBy("name", "rtl", "line_chars", "cps").agg(F.count("*").alias("n"))


def punctuation_attach(spark, sf_dir):
    """Words of turns with the times of their tokens, a tenth of a second a letter."""
    c = cues(spark, sf_dir).withColumn("t", text.tokens(F.col("text")))
    p = c.select("key", "number", F.posexplode("t").alias("id", "text")).withColumns({"s": F.col("id").cast("long") * 100_000, "e": F.col("id").cast("long") * 100_000 + 90_000})
    got = rp.attach_punctuation(c.select("key", "number", "text"), p, ["key", "number"])
    return got.groupBy("key", "number").agg(F.count("*").alias("words"), F.count("s").alias("timed"), F.max("e").alias("e"))


def alike_dedup(spark, sf_dir):
    """Events as lines that say their type; every third is a dropped one."""
    d = spans(spark, sf_dir).withColumns({"text": F.col("label"), "dropped": F.col("id") % 3 == 0})
    return rp.hand_over_copies(d, K, DAY).groupBy("key").agg(F.count("*").alias("n"), F.sum("s").alias("s"))


def fault_injection(spark, sf_dir):
    d = spans(spark, sf_dir).withColumn("text", F.col("label"))
    got = rp.inject(d, K, "relabelled", 0.1)
    return got.groupBy("label", "fault").agg(F.count("*").alias("n"))


def bench_cells(spark, sf_dir):
    clips = table(spark, sf_dir, "nation").select(F.col("n_name").alias("clip"))
    faults = table(spark, sf_dir, "region").select(F.when(F.col("r_regionkey") == 0, "none").otherwise(F.col("r_name")).alias("fault"))
    settings = spark.sql("SELECT * FROM VALUES (true), (false) AS s(local)")
    return rp.bench_cells(clips, faults, settings, 2)


QUERIES = {f.__name__: f for f in (lines_said_before, timed_over, sentence_home, missing_words, contract_recall, ask_budget, densest_sample, text_bands, placement, voices_told_apart, speech_tiers, segment_homes, drift_anchor, similar_lines, newest_events, language_dimension, punctuation_attach, alike_dedup, fault_injection, bench_cells)}

_W = "PARTITION BY key ORDER BY s, e, id"
SQL = {
    "lines_said_before": f"""WITH {LINES}, l AS (SELECT key, number AS line, number * 1000000 AS s, number * 1000000 + 900000 AS e, {_tokens('text')} AS t FROM lines),
  b AS (SELECT key, line, s, e, t, list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS g FROM l),
  mine AS (SELECT DISTINCT key, line, s, e, unnest(CASE WHEN len(t) > 1 THEN g ELSE t END) AS gram FROM b),
  theirs AS (SELECT DISTINCT key, line, s - 3000000 AS s, e + 3000000 AS e, unnest(list_concat(g, t)) AS gram FROM b),
  h AS (SELECT m.key, m.line, count(DISTINCT m.gram) AS hits FROM mine m JOIN theirs o ON o.key = m.key AND o.gram = m.gram AND o.line <> m.line AND o.s <= m.e AND m.s <= o.e GROUP BY ALL),
  n AS (SELECT key, line, count(*) AS total FROM mine GROUP BY ALL)
  SELECT l.key, count(*) FILTER (coalesce(h.hits, 0) >= 0.6 * n.total) AS old, count(*) AS n FROM l LEFT JOIN n USING (key, line) LEFT JOIN h USING (key, line) GROUP BY l.key""",
    "sentence_home": f"""WITH {SPANS}, s AS (SELECT key, id AS line, s, e, 'view' AS label FROM spans WHERE label IN ('purchase', 'error')), w AS (SELECT *, (s + e) // 2 AS m FROM spans WHERE label IN ('view', 'click')),
  d AS (SELECT w.id, s.line, row_number() OVER (PARTITION BY w.id ORDER BY greatest(s.s - m, m - s.e, 0) + CASE WHEN s.label = w.label THEN 0 ELSE 1000000000 END, s.line) AS k FROM w LEFT JOIN s ON s.key = w.key)
  SELECT id, line AS home FROM d WHERE k = 1""",
    "missing_words": f"""WITH {CUES}, w AS (SELECT key, unnest({_tokens('text')}) AS token, start_ms AS s, (start_ms + end_ms) // 2 AS m FROM cues),
  c AS (SELECT key, start_ms + 30000 - 300 AS s, end_ms + 30000 + 300 AS e, {_tokens('text')} AS t FROM cues)
  SELECT key, count(*) AS missing FROM w WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.key = w.key AND c.s <= w.s AND w.m <= c.e AND list_contains(c.t, w.token)) GROUP BY key""",
    "contract_recall": f"""WITH {SPANS}, f AS (SELECT * FROM spans WHERE label = 'error'), r AS (SELECT * FROM spans WHERE label = 'click'),
  a AS (SELECT key, count(*) AS faults, count(*) FILTER (EXISTS (SELECT 1 FROM r WHERE r.key = f.key AND r.s < f.e AND f.s < r.e)) AS hit FROM f GROUP BY key),
  b AS (SELECT key, count(*) AS flagged, count(*) FILTER (NOT EXISTS (SELECT 1 FROM f WHERE r.key = f.key AND r.s < f.e AND f.s < r.e)) AS false_alarms FROM r GROUP BY key)
  SELECT key, coalesce(faults, 0) AS faults, coalesce(hit, 0) AS hit, coalesce(flagged, 0) AS flagged, coalesce(false_alarms, 0) AS false_alarms FROM a FULL JOIN b USING (key)""",
    "text_bands": f"""WITH {SPANS}, d AS (SELECT key, id AS frame, unnest(range(40)) AS row FROM spans), n AS (SELECT key, count(DISTINCT frame) AS frames FROM d GROUP BY key),
  g AS (SELECT key, row, count(*) FILTER ((frame * 7 + row) % 40 < 12 + row / 8) AS n FROM d GROUP BY key, row), l AS (SELECT key, row FROM g JOIN n USING (key) WHERE frames >= 4 AND g.n >= 0.35 * frames),
  i AS (SELECT key, row, row - row_number() OVER (PARTITION BY key ORDER BY row) AS g FROM l), b AS (SELECT key, min(row) AS s, max(row) + 1 AS e FROM i GROUP BY key, g)
  SELECT key, round(greatest((s - 0.4 * (e - s)) / 40, 0.0), 6) AS top, round(least((e + 0.4 * (e - s)) / 40, 1.0), 6) AS bottom FROM b""",
    "voices_told_apart": f"""WITH {SPANS}, n AS (SELECT key, label, s, lead(s) OVER (PARTITION BY key, label ORDER BY s, id) AS until FROM spans)
  SELECT DISTINCT n.key, least(n.label, o.label) AS a, greatest(n.label, o.label) AS b FROM n JOIN spans o ON o.key = n.key AND o.label <> n.label AND n.s < o.s AND o.s <= n.until WHERE n.until - n.s <= {5 * DAY}""",
    "speech_tiers": f"""WITH {SPANS}, m AS (SELECT key, id, label = 'view' AS vad, sum((id * 37 % 100) / 100.0) OVER (PARTITION BY key ORDER BY id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS smooth FROM spans),
  t AS (SELECT key, coalesce(greatest(0.05, least(0.3, 0.5 * median(smooth) FILTER (vad))), 0.05) AS tau FROM m GROUP BY key)
  SELECT key, count(*) FILTER (vad OR smooth >= tau) AS speech, round(CAST(max(tau) AS DOUBLE), 6) AS tau FROM m JOIN t USING (key) GROUP BY key""",
    "segment_homes": f"""WITH {SPANS} SELECT id, (SELECT count(*) FROM spans c WHERE c.key = p.key AND c.label = 'purchase' AND c.s <= p.s) AS segment FROM spans p WHERE label <> 'purchase'""",
    "drift_anchor": f"""WITH {SPANS}, p AS (SELECT key, id // 500 AS line, id, CASE WHEN label <> 'error' THEN e - s END AS delta FROM spans),
  k AS (SELECT *, row_number() OVER (PARTITION BY key, line ORDER BY delta IS NULL, id) AS k FROM p),
  g AS (SELECT key, line, count(delta) AS n, count(*) AS a, median(delta) FILTER (k <= 3) AS delta FROM k GROUP BY key, line) SELECT key, line, delta FROM g WHERE n >= greatest(2, a / 2) AND abs(delta) >= {HOUR // 4}""",
    "newest_events": f"WITH {SPANS}, k AS (SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY s DESC, id) AS k FROM spans) SELECT key, id FROM k WHERE k <= 5",
}
SQL["language_dimension"] = f"""WITH l(code, name, rtl, line_chars, cps) AS (VALUES {", ".join(f"('{c}', '{n}', {r}, {lc}, {cps}::DOUBLE)" for c, n, r, lc, cps, _ in LANGUAGES)})
  SELECT coalesce(name, lang) AS name, coalesce(rtl, false) AS rtl, CAST(coalesce(line_chars, 42) AS INTEGER) AS line_chars, coalesce(cps, 17.0::DOUBLE) AS cps, count(*) AS n FROM documents LEFT JOIN l ON code = lang GROUP BY ALL"""
SQL["bench_cells"] = """WITH f AS (SELECT CASE WHEN r_regionkey = 0 THEN 'none' ELSE r_name END AS fault FROM region), s(local) AS (VALUES (true), (false))
  SELECT n_name AS clip, fault, local, CAST(seed AS INTEGER) AS seed FROM nation, f, s, (VALUES (0), (1)) v(seed) WHERE fault <> 'none' OR seed = 0"""
_BY_ID = "PARTITION BY key ORDER BY id"
SQL["ask_budget"] = f"""WITH RECURSIVE {SPANS}, o AS (SELECT key, e - s AS cost, row_number() OVER ({_BY_ID}) AS k FROM spans),
  r AS (SELECT key, k, 1 AS made, cost AS sent, true AS ok, cost FROM o WHERE k = 1
    UNION ALL SELECT o.key, o.k, made + CASE WHEN made < 9 AND sent + o.cost <= {6 * HOUR} THEN 1 ELSE 0 END, sent + CASE WHEN made < 9 AND sent + o.cost <= {6 * HOUR} THEN o.cost ELSE 0 END, made < 9 AND sent + o.cost <= {6 * HOUR}, o.cost FROM r JOIN o ON o.key = r.key AND o.k = r.k + 1)
  SELECT key, count(*) FILTER (ok) AS allowed, CAST(sum(CASE WHEN ok THEN cost ELSE 0 END) AS BIGINT) AS us FROM r GROUP BY key"""
SQL["densest_sample"] = f"""WITH RECURSIVE {SPANS}, o AS (SELECT key, s, e, len(label) AS words, row_number() OVER ({_W}) AS k FROM spans),
  r AS (SELECT key, k, 0 AS g, s AS gs, e AS ge, CAST(words AS BIGINT) AS gw FROM o WHERE k = 1
    UNION ALL SELECT o.key, o.k, CASE WHEN o.e - gs <= {DAY} THEN g ELSE g + 1 END, CASE WHEN o.e - gs <= {DAY} THEN gs ELSE o.s END, CASE WHEN o.e - gs <= {DAY} THEN greatest(ge, o.e) ELSE o.e END, CASE WHEN o.e - gs <= {DAY} THEN gw + o.words ELSE o.words END FROM r JOIN o ON o.key = r.key AND o.k = r.k + 1),
  f AS (SELECT key, g, max(gs) AS s, max(ge) AS e, max(gw) AS words FROM r GROUP BY key, g), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY words / greatest(e - s, 20000) DESC, s) AS k FROM f WHERE e - s <= {DAY})
  SELECT key, CAST(g AS INTEGER) AS "group", s, e, words FROM n WHERE k <= 3"""
SQL["placement"] = f"""WITH RECURSIVE {SPANS}, b AS (SELECT key, (id % 90) / 100 AS top, (id % 90 + 6) / 100 AS bottom, row_number() OVER (PARTITION BY key ORDER BY (id % 90 + 6) / 100 DESC, (id % 90) / 100 DESC) AS k FROM spans),
  r AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS k, 60 AS m FROM b
    UNION ALL SELECT b.key, b.k, CASE WHEN top * 1080 < 1080 - m + 20 AND bottom * 1080 > 1080 - m - 120 - 20 THEN CAST(round_even(1080 - top * 1080 + 20, 0) AS INTEGER) ELSE m END FROM r JOIN b ON b.key = r.key AND b.k = r.k + 1)
  SELECT key, max_by(m, k) AS margin FROM r GROUP BY key"""
SQL["timed_over"] = f"""WITH {SPANS}, o AS (SELECT key, s, e, max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans WHERE label <> 'view'),
  g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM o), i AS (SELECT key, g, min(s) AS s, max(e) AS e FROM g GROUP BY key, g),
  l AS (SELECT v.key, v.id, v.s, v.e, sum(greatest(0, least(v.e, i.e) - greatest(v.s, i.s))) AS us FROM spans v JOIN i ON i.key = v.key AND i.s < v.e AND v.s < i.e WHERE v.label = 'view' GROUP BY ALL)
  SELECT key, id AS line FROM l WHERE us > 0.5 * greatest(e - s, 10000)"""
SQL["alike_dedup"] = f"""WITH {SPANS}, d AS (SELECT key, id, s, e, label, id % 3 = 0 AS dropped FROM spans),
  n AS (SELECT *, lead(s) OVER w AS ns, lead(dropped) OVER w AS nd, lag(e) OVER w AS be, lag(dropped) OVER w AS bd FROM d WINDOW w AS (PARTITION BY key, label ORDER BY s, id)),
  t AS (SELECT *, dropped AND coalesce(NOT nd, false) AND coalesce(ns <= e + {DAY}, false) AS takes, NOT dropped AND coalesce(bd, false) AND coalesce(s <= be + {DAY}, false) AS gives FROM n)
  SELECT key, count(*) AS n, CAST(sum(CASE WHEN takes THEN ns ELSE s END) AS BIGINT) AS s FROM t WHERE (NOT dropped OR takes) AND NOT gives GROUP BY key"""
SQL["punctuation_attach"] = f"""WITH {CUES}, w AS (SELECT key, number, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM (SELECT key, number, regexp_extract_all(text, '\\S+') AS t FROM cues)),
  wl AS (SELECT *, len(regexp_replace(word, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS n FROM w), wc AS (SELECT *, sum(n) OVER (PARTITION BY key, number ORDER BY pos) AS e FROM wl),
  p AS (SELECT key, number, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS id FROM (SELECT key, number, {_tokens('text')} AS t FROM cues)),
  pl AS (SELECT *, len(regexp_replace(token, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS n FROM p), pc AS (SELECT *, sum(n) OVER (PARTITION BY key, number ORDER BY id) AS e FROM pl),
  j AS (SELECT wc.key, wc.number, wc.pos, min(pc.id) AS a, max(pc.id) AS b FROM wc LEFT JOIN pc ON pc.key = wc.key AND pc.number = wc.number AND wc.e - wc.n < pc.e AND pc.e - pc.n < wc.e GROUP BY ALL)
  SELECT key, number, count(*) AS words, count(a) AS timed, max(b * 100000 + 90000) AS e FROM j GROUP BY key, number"""
SQL["fault_injection"] = f"""WITH {SPANS}, f AS (SELECT label, CAST('0x' || left(md5('1:' || key || ':' || id), 8) AS BIGINT) / 4294967296 < 0.1 AS fault FROM spans)
  SELECT CASE WHEN fault THEN label || '~x1' ELSE label END AS label, fault, count(*) AS n FROM f GROUP BY ALL"""
