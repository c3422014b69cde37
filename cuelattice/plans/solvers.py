"""Queries on order-dependent solvers; those without SQL are tested against expectations of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import shapes, text
from ..operators import alignment as al
from ..operators import build as bu
from ..operators import cues as cu
from ..operators import fitting as fi
from .adapters import CUES, HOUR, SPANS, cues, pairs, spans, table, voices
from .dialogue import _tokens

K = ["key"]
PIECE = ["key", "piece"]


def _passes(spark, sf_dir):
    """Turns of conversations as lines of three passes; the later ones drop every seventh or fifth word.

    A piece is what starts within 75 seconds: passes are compared piece by piece.
    """
    c = cues(spark, sf_dir).withColumn("t", text.tokens(F.col("text"))).withColumn("n", F.size("t"))
    c = c.select("key", F.col("number").alias("line"), F.posexplode("t").alias("at", "token"), "start_ms", "end_ms", "n")
    long = F.col("end_ms") - F.col("start_ms")
    w = c.select("key", F.floor(F.col("start_ms") / 75_000).alias("piece"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("pass"), "line", (F.col("line") * 100_000 + F.col("at")).cast("long").alias("seq"), "token", "at", (F.col("start_ms") * 1000 + F.floor(long * 1000 * F.col("at") / F.col("n"))).cast("long").alias("s"), (F.col("start_ms") * 1000 + F.floor(long * 1000 * (F.col("at") + 1) / F.col("n"))).cast("long").alias("e"))
    return w.where("pass = 0 or (pass = 1 and at % 7 <> 3) or (pass = 2 and at % 5 <> 2)").drop("at")


def vote_full(spark, sf_dir):
    return al.vote(_passes(spark, sf_dir), PIECE)


def pass_order(spark, sf_dir):
    return al.ordered_passes(_passes(spark, sf_dir), PIECE).select(*PIECE, "pass", "place", "passes")


def witness_count(spark, sf_dir):
    return al.witnesses(_passes(spark, sf_dir), PIECE).groupBy("key", "backed").agg(F.count("*").alias("n"))


def witness_bands(spark, sf_dir):
    """Whole conversations, their words stretch by stretch against the two other passes."""
    w = _passes(spark, sf_dir).drop("piece")
    return al.banded_witnesses(w.where("pass = 0").drop("pass"), w.where("pass > 0"), K).groupBy("key", "backed").agg(F.count("*").alias("n"))


def hearing_chosen(spark, sf_dir):
    """Of every other conversation the local words are its first turn's; the others are judged by how much the vote kept."""
    w = _passes(spark, sf_dir).withColumn("clip", F.concat_ws(":", "key", "piece")).drop("key", "piece")
    local = w.where("pass = 1 AND line = 0 AND CAST(split(clip, ':')[0] AS BIGINT) % 2 = 0").groupBy("clip").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "token"))), lambda x: x["token"]).alias("said"))
    return al.chosen_hearing(w, al.vote(w, ["clip"]), ["clip"], local).groupBy("by", "pass").agg(F.count("*").alias("n"))


def edit_path(spark, sf_dir):
    """Each turn against the next one's words, by conversation."""
    d = pairs(spark, sf_dir).select("key", "number", text.tokens(F.col("source")).alias("said"), text.tokens(F.col("target")).alias("wrote"))
    return al.error_rate(d, ["key", "number"], ["key"])


def voice_groups(spark, sf_dir):
    got = al.voice_groups(voices(spark, sf_dir).withColumn("clip", F.floor(F.col("id") / 200)), ["clip"], 0.9)
    return got.groupBy("clip").agg(F.countDistinct("voice").alias("voices"), F.count("*").alias("prints"))


def forced_alignment(spark, sf_dir):
    """Emissions made of embeddings: the frames are vectors, letters their first four places."""
    d = voices(spark, sf_dir).select((F.floor(F.col("id") / 50)).alias("clip"), (F.col("id") % 50).alias("frame"), F.slice("vec", 1, 4).alias("logp"), F.array(F.lit(1), F.lit(2), F.lit(1), F.lit(3)).alias("labels"))
    return al.forced_alignment(d, ["clip"])


def cue_words(spark, sf_dir):
    """Words of conversations with times by their letters."""
    c = cues(spark, sf_dir).withColumn("t", text.words(F.col("text"))).withColumn("n", F.size("t"))
    c = c.select("key", "number", "speaker", F.posexplode("t").alias("at", "w"), "start_ms", "end_ms", "n")
    at = lambda k: (F.col("start_ms") * 1000 + F.floor((F.col("end_ms") - F.col("start_ms")) * 1000 * k / F.col("n"))).cast("long")
    return c.select("key", (F.col("number") * 100_000 + F.col("at")).cast("long").alias("id"), F.col("speaker").alias("label"), F.col("w").alias("text"), at(F.col("at")).alias("s"), at(F.col("at") + 1).alias("e"))


def cue_build(spark, sf_dir):
    return bu.build_cues(cue_words(spark, sf_dir), K)


def cue_timing(spark, sf_dir):
    return fi.fit_cues(cue_build(spark, sf_dir), K).select("key", "number", "start_ms", "end_ms", "parts", "joined")


def replies_over(spark, sf_dir):
    return bu.said_over(spans(spark, sf_dir), K, inside_us=HOUR // 12).where("over").select("key", "id")


def piece_plan(spark, sf_dir):
    """Conversations cut every minute at the pauses behind turns; a turn's last tenth is its pause."""
    c = cues(spark, sf_dir)
    clips = c.groupBy("key").agg(F.max("end_ms").alias("length"))
    pauses = c.select("key", (F.col("end_ms") - F.floor((F.col("end_ms") - F.col("start_ms")) / 10)).alias("s"), F.col("end_ms").alias("e"))
    return cu.piece_plan(clips, pauses, K, 60_000, most=12_000)


def speech_map(spark, sf_dir):
    """Runs of equal labels of a user's events, coded and decoded."""
    d = spans(spark, sf_dir).withColumn("tier", F.when(F.col("label") == "view", 2).when(F.col("label") == "click", 1).otherwise(0))
    got = d.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("s", "e", "id", "tier"))), lambda x: x["tier"]).alias("v"))
    runs = shapes.run_lengths(F.col("v"))
    return got.select("key", F.size(runs).cast("long").alias("runs"), (shapes.from_run_lengths(runs) == F.col("v")).alias("same"), F.array_max(F.transform(runs, lambda r: r["n"])).cast("long").alias("longest"))


def cut_spacing(spark, sf_dir):
    d = spans(spark, sf_dir).groupBy("key").agg(F.collect_list((F.col("s") / 1e6).alias("t")).alias("t"))
    return d.select("key", F.size(shapes.spaced_out(F.col("t"), 86400.0)).cast("long").alias("cuts"))


def minutes_read_back(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 700).cast("double").alias("t"))
    return d.select("event_id", shapes.read_back(F.col("t")).alias("seconds"))


QUERIES = {f.__name__: f for f in (vote_full, pass_order, witness_count, witness_bands, hearing_chosen, edit_path, voice_groups, forced_alignment, cue_build, cue_timing, replies_over, piece_plan, speech_map, cut_spacing, minutes_read_back)}

_W = "PARTITION BY key ORDER BY s, e, id"
SQL = {
    "replies_over": f"""WITH {SPANS}, f AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER ({_W}) THEN 1 ELSE 0 END AS fresh, max(e) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
  t AS (SELECT *, sum(fresh) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS turn FROM f),
  z AS (SELECT *, count(*) OVER p AS size, min(s) OVER p AS st, first_value(reach) OVER (PARTITION BY key, turn ORDER BY s, e, id) AS r FROM t WINDOW p AS (PARTITION BY key, turn))
  SELECT key, id FROM z WHERE size <= 4 AND st + {HOUR // 12} <= r""",
    "speech_map": f"""WITH {SPANS}, t AS (SELECT *, CASE label WHEN 'view' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS tier FROM spans),
  f AS (SELECT *, CASE WHEN tier IS DISTINCT FROM lag(tier) OVER ({_W}) THEN 1 ELSE 0 END AS fresh FROM t), r AS (SELECT *, sum(fresh) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS run FROM f),
  n AS (SELECT key, run, count(*) AS n FROM r GROUP BY key, run) SELECT key, count(*) AS runs, true AS same, max(n) AS longest FROM n GROUP BY key""",
    "minutes_read_back": "SELECT event_id, CASE WHEN (event_id % 700) % 100 < 60 THEN CAST(60 * ((event_id % 700) // 100) + (event_id % 700) % 100 AS DOUBLE) END AS seconds FROM events",
}
SQL["pass_order"] = f"""WITH {CUES}, t AS (SELECT key, number AS line, start_ms, end_ms, {_tokens('text')} AS t FROM cues),
  u AS (SELECT key, line, start_ms, end_ms, len(t) AS n, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM t),
  w AS (SELECT key, start_ms // 75000 AS piece, p AS pass, line, pos, token, start_ms * 1000 + (end_ms - start_ms) * 1000 * pos // n AS s, start_ms * 1000 + (end_ms - start_ms) * 1000 * (pos + 1) // n AS e FROM u, (VALUES (0), (1), (2)) v(p) WHERE p = 0 OR (p = 1 AND pos % 7 <> 3) OR (p = 2 AND pos % 5 <> 2)),
  g AS (SELECT key, piece, pass, count(*) AS words, count(DISTINCT line) AS lines, list({{'s': s, 'e': e, 't': token}} ORDER BY line, pos) AS content FROM w GROUP BY ALL)
  SELECT key, piece, pass, CAST(row_number() OVER (PARTITION BY key, piece ORDER BY words DESC, lines DESC, content, pass) - 1 AS INTEGER) AS place, count(*) OVER (PARTITION BY key, piece) AS passes FROM g"""
SQL["cut_spacing"] = f"""WITH RECURSIVE {SPANS}, o AS (SELECT key, s / 1e6 AS t, row_number() OVER (PARTITION BY key ORDER BY s) AS k FROM spans),
  r AS (SELECT key, k, t AS last, 1 AS cuts FROM o WHERE k = 1 UNION ALL SELECT o.key, o.k, CASE WHEN t - last >= 86400 THEN t ELSE last END, CASE WHEN t - last >= 86400 THEN cuts + 1 ELSE cuts END FROM r JOIN o ON o.key = r.key AND o.k = r.k + 1)
  SELECT key, CAST(max(cuts) AS BIGINT) AS cuts FROM r GROUP BY key"""
