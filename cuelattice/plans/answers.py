"""Queries on replies, scripts, settings and small choices, each made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import shapes, text
from ..operators import cues as cu
from ..operators import fitting as fi
from ..operators import places as pl
from ..operators import settings as st
from ..operators import speakers as sp
from ..operators import translation as tr
from ..sources import readers, sinks
from .adapters import CUES, HOUR, PAIRS, SPANS, cues, pairs, spans, table
from .dialogue import _RANKS, _ass, _letters, _numbers, _plain, _tokens

K = ["key"]


def json_replies(spark, sf_dir):
    """Events as JSON replies: every fourth has no end, every fifth no text, every seventh is broken."""
    k = F.col("event_id")
    reply = F.when(k % 7 == 0, "[{broken").otherwise(F.concat(F.lit('[{"start": '), k % 50, F.when(k % 4 == 0, "").otherwise(F.concat(F.lit(', "end": '), k % 60)), F.lit(', "text": "'), F.when(k % 5 == 0, " ").otherwise(F.col("event_type")), F.lit('"}]')))
    d = readers.parse_replies(table(spark, sf_dir, "events").select("event_id", reply.alias("reply")))
    return d.select("event_id", "s", "e", "text")


def script_lines(spark, sf_dir):
    k = F.col("event_id")
    line = F.when(k % 6 == 0, F.lit("no line of a script")).otherwise(F.concat(F.lit("S"), k % 3, F.when(k % 2 == 0, " +").otherwise(" -"), k % 10, F.lit(".5: "), F.col("event_type")))
    return readers.parse_script(table(spark, sf_dir, "events").select("event_id", line.alias("line")))


def answers_unfolded(spark, sf_dir):
    k = F.col("event_id")
    inner = F.concat(F.lit('{"text": "'), F.col("event_type"), F.lit('"}'))
    outer = F.to_json(F.struct(inner.alias("text")))
    d = readers.unfolded(table(spark, sf_dir, "events").select("event_id", F.when(k % 2 == 0, outer).otherwise(inner).alias("body")), "body", "text")
    return d.select("event_id", F.get_json_object("body", "$.text").alias("text"))


def review_json(spark, sf_dir):
    c = cues(spark, sf_dir)
    doubts = c.where("number % 3 = 0").select("key", "number", F.explode(F.array(F.lit("weak"), F.lit("alone"))).alias("kind"))
    got = sinks.review_rows(c, doubts, K)
    field = lambda f: F.get_json_object("review", f"$.{f}")
    return got.select("key", "number", field("start").cast("double").alias("start"), field("end").cast("double").alias("end"), F.length(field("text")).cast("long").alias("chars"), field("doubts").alias("doubts"))


def retry_lines(spark, sf_dir):
    d = pairs(spark, sf_dir).withColumns({"text": F.when(F.col("number") % 2 == 0, F.lit(" ")).otherwise(F.col("target")), "source": F.when(F.col("number") % 4 == 0, F.lit("Hmmm...")).when(F.col("key") % 5 == 0, F.lit("12:30")).otherwise(F.col("source"))})
    return tr.needs_retry(d).select("key", "number")


def long_parts(spark, sf_dir):
    t = F.when(F.col("number") % 2 == 0, F.concat("text", F.lit("||"), "speaker")).otherwise(F.col("text"))
    budgets = F.array(F.lit(200).cast("long"), F.lit(6).cast("long"))
    return cues(spark, sf_dir).select("key", "number", text.parts_too_long(t, budgets).alias("too_long"))


def free_names(spark, sf_dir):
    """The first free name among those whose numbers a user's events leave over."""
    d = spans(spark, sf_dir).groupBy("key").agg(F.collect_set(F.concat(F.lit("S"), F.col("id") % 7 + 1)).alias("taken"))
    return d.select("key", text.first_free("S", F.col("taken")).alias("name"))


def enlarged_frames(spark, sf_dir):
    k = F.col("p_partkey")
    got = shapes.enlarged((300 + k % 40 * 50).cast("double"), (200 + k % 30 * 40).cast("double"), 1920, 1080)
    return table(spark, sf_dir, "part").select("p_partkey", got["width"].alias("width"), got["height"].alias("height"))


def plausible_words(spark, sf_dir):
    d = spans(spark, sf_dir)
    ok = shapes.plausible_word((F.col("e") - F.col("s")) / 6e7, F.length("label"))
    return d.groupBy("label").agg(F.count_if(ok).alias("plausible"), F.count("*").alias("n"))


def settings_resolved(spark, sf_dir):
    stored = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("name"), F.col("n_name").alias("value"))
    defaults = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("name"), F.col("r_name").alias("value"))
    return st.resolve(stored, defaults, ["id"])


def settings_kept(spark, sf_dir):
    """What differs from the defaults; every third value is the default itself."""
    every = settings_resolved(spark, sf_dir)
    defaults = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("name"), F.col("r_name").alias("value"))
    return st.snapshot(every, defaults).select("id", "name", "value")


def voice_majority(spark, sf_dir):
    """The label that most of a user's time went to, by day."""
    d = spans(spark, sf_dir).select("key", F.floor(F.col("s") / (24 * HOUR)).alias("day"), "label", (F.col("e") - F.col("s")).alias("us"))
    return sp.majority(d, ["key", "day"], "label", "us")


def voice_names(spark, sf_dir):
    """Labels named by the hour of the day they take most time in, one to one, the most time first."""
    d = spans(spark, sf_dir).select("key", "label", F.concat(F.lit("h"), F.floor(F.col("s") / HOUR) % 6).alias("name"), (F.col("e") - F.col("s")).alias("us"))
    n = d.groupBy("key", "label", "name").agg(F.sum("us").alias("us"))
    return sp.named_greedily(n, K, "label", "name", "us").select("key", "label", "name", F.col("us").cast("long").alias("us"))


def ass_text(spark, sf_dir):
    c = cues(spark, sf_dir)
    got = cu.ass_files(c, K, sp.talk_ranking(c, K).select("key", "speaker", "rank"))
    return got.select("key", F.md5("ass").alias("ass"), F.length("ass").cast("long").alias("chars"))


def unfaithful_lines(spark, sf_dir):
    g = spark.sql("SELECT * FROM VALUES ('the', 'thth'), ('and', 'anan') AS g(term, meaning)")
    d = pairs(spark, sf_dir).withColumn("source", F.concat("source", F.lit(" 1,234")))
    return tr.unfaithful(d, K, g).select("key", "number", F.array_join("kinds", ",").alias("kinds"))


def retimed_words(spark, sf_dir):
    """Turns written half a minute late, timed by what was heard of them: every event's id is a word of its own."""
    d = spans(spark, sf_dir).where("e > s").withColumn("line", F.floor(F.col("s") / (6 * HOUR)))
    lines = d.groupBy("key", "line").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    late = lambda c: (F.col(c) + F.when(F.col("line") % 2 == 0, 12 * HOUR).otherwise(0)).alias(c)
    w = d.select("key", "line", "id", F.col("id").cast("string").alias("token"), late("s"), late("e"))
    h = d.where("id % 3 > 0").select("key", "id", F.col("id").cast("string").alias("token"), "s", "e")
    return pl.retimed(w, lines, h, K, HOUR // 60, HOUR).groupBy("key", "source").agg(F.count("*").alias("n"))


def cue_fitting(spark, sf_dir):
    """Turns of conversations at twenty letters a second, shown as subtitles; each tenth is a cut of the picture."""
    c = cues(spark, sf_dir).select("key", "number", F.col("speaker").alias("label"), "text", (F.col("start_ms") / 20).cast("long").alias("start_ms"), (F.col("end_ms") / 20).cast("long").alias("end_ms"))
    return fi.fit_cues(c, K, c.where("number % 10 = 9").select("key", F.col("start_ms").alias("at_ms")))


QUERIES = {f.__name__: f for f in (json_replies, script_lines, answers_unfolded, review_json, retry_lines, long_parts, free_names, enlarged_frames, plausible_words, settings_resolved, settings_kept, voice_majority, voice_names, ass_text, unfaithful_lines, retimed_words, cue_fitting)}

SQL = {
    "json_replies": """WITH r AS (SELECT event_id, event_id % 50 AS a, CASE WHEN event_id % 4 > 0 THEN event_id % 60 END AS b, event_type AS text FROM events WHERE event_id % 7 > 0 AND event_id % 5 > 0)
  SELECT event_id, CAST(a * 1000000 AS BIGINT) AS s, CAST(CASE WHEN b IS NULL OR b <= a THEN round((a + greatest(0.3, len(text) * 0.07)) * 1000000) ELSE b * 1000000 END AS BIGINT) AS e, text FROM r""",
    "script_lines": "SELECT event_id, 'S' || event_id % 3 AS speaker, event_id % 10 + 0.5::DOUBLE AS offset_s, event_id % 2 = 1 AS overlap, event_type AS text FROM events WHERE event_id % 6 > 0",
    "answers_unfolded": "SELECT event_id, event_type AS text FROM events",
    "review_json": f"""WITH {CUES} SELECT key, number, round_even(CAST(start_ms AS DOUBLE) / 1000, 2) AS start, round_even(CAST(end_ms AS DOUBLE) / 1000, 2) AS "end", len(text) AS chars, CASE WHEN number % 3 = 0 THEN '["alone","weak"]' ELSE '[]' END AS doubts FROM cues""",
    "retry_lines": f"""WITH {PAIRS} SELECT key, number FROM pairs WHERE (number % 2 = 0 OR trim(target) = '') AND number % 4 <> 0 AND key % 5 <> 0 AND regexp_matches(source, '\\p{{L}}')""",
    "long_parts": f"""WITH {CUES} SELECT key, number, CASE WHEN number % 2 = 0 THEN len(trim(text)) > 200 OR len(trim(speaker)) > 6 ELSE len(text) > 206 END AS too_long FROM cues""",
    "free_names": f"""WITH {SPANS}, f AS (SELECT k.key, i FROM (SELECT DISTINCT key FROM spans) k, range(1, 9) r(i) WHERE NOT EXISTS (SELECT 1 FROM spans p WHERE p.key = k.key AND p.id % 7 + 1 = i)) SELECT key, 'S' || min(i) AS name FROM f GROUP BY key""",
    "enlarged_frames": """WITH s AS (SELECT p_partkey, 300 + p_partkey % 40 * 50 AS w, 200 + p_partkey % 30 * 40 AS h FROM part), c AS (SELECT *, least(1920 / w, 1080 / h) AS scale FROM s)
  SELECT p_partkey, CASE WHEN scale >= 1.1 THEN CAST(2 * round_even(w * scale / 2, 0) AS INTEGER) END AS width, CASE WHEN scale >= 1.1 THEN CAST(2 * round_even(h * scale / 2, 0) AS INTEGER) END AS height FROM c""",
    "plausible_words": f"WITH {SPANS} SELECT label, count(*) FILTER (e > s AND (e - s) / 6e7 <= 2 * (0.3 + 0.1 * len(label))) AS plausible, count(*) AS n FROM spans GROUP BY label",
    "settings_resolved": "SELECT n_nationkey AS id, 'r' || r_regionkey AS name, CASE WHEN r_regionkey = n_regionkey THEN n_name ELSE r_name END AS value FROM nation, region",
    "settings_kept": "SELECT n_nationkey AS id, 'r' || n_regionkey AS name, n_name AS value FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_name <> r_name",
    "voice_majority": f"""WITH {SPANS}, n AS (SELECT key, s // {24 * HOUR} AS day, label, CAST(sum(e - s) AS BIGINT) AS us FROM spans GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY key, day ORDER BY us DESC, label) AS k FROM n) SELECT key, day, label, us FROM k WHERE k = 1""",
    "voice_names": f"""WITH RECURSIVE {SPANS}, n AS (SELECT key, label, 'h' || (s // {HOUR}) % 6 AS name, CAST(sum(e - s) AS BIGINT) AS us FROM spans GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY us DESC, label, name) AS k FROM n),
  r AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS ls, CAST([] AS VARCHAR[]) AS ns, false AS ok, NULL::VARCHAR AS label, NULL::VARCHAR AS name, NULL::BIGINT AS us FROM o
    UNION ALL SELECT o.key, o.k, CASE WHEN list_contains(ls, o.label) OR list_contains(ns, o.name) THEN ls ELSE list_append(ls, o.label) END, CASE WHEN list_contains(ls, o.label) OR list_contains(ns, o.name) THEN ns ELSE list_append(ns, o.name) END,
      NOT (list_contains(ls, o.label) OR list_contains(ns, o.name)), o.label, o.name, o.us FROM r JOIN o ON o.key = r.key AND o.k = r.k + 1)
  SELECT key, label, name, us FROM r WHERE ok""",
}
_HEAD = "[Script Info]\\nScriptType: v4.00+\\nWrapStyle: 0\\nScaledBorderAndShadow: yes\\nPlayResX: 1920\\nPlayResY: 1080\\n\\n" + "\\n".join(cu.ASS_STYLES) + "\\nStyle: Default,Sans,63,&H00F0F5F7,&H000000FF,&H4F131415,&H4F131415,0,0,0,0,100,100,0,0,3,3.8,0,2,96,96,76,1\\n\\n" + "\\n".join(cu.ASS_EVENTS)
SQL["ass_text"] = f"""WITH {CUES}, {_RANKS}, c AS (SELECT c.*, least(200, (end_ms - start_ms) // 4) AS fade, ['#f7f5f0','#ffe066','#8fe3f5','#a8e6a1'][CASE WHEN r.rank = 0 THEN 1 ELSE (r.rank - 1) % 3 + 2 END] AS colour FROM cues c JOIN ranks r USING (key, speaker)),
  e AS (SELECT key, number, 'Dialogue: 0,' || {_ass('start_ms')} || ',' || {_ass('end_ms')} || ',Default,,0,0,0,,' || '{{\\fad(' || fade || ',' || fade || ')\\c' || upper('&H00' || colour[6:7] || colour[4:5] || colour[2:3]) || '&}}' || replace({_plain('text')}, chr(10), '\\N') AS event FROM c),
  f AS (SELECT key, replace('{_HEAD}', '\\n', chr(10)) || chr(10) || string_agg(event, chr(10) ORDER BY number) || chr(10) AS ass FROM e GROUP BY key) SELECT key, md5(ass) AS ass, len(ass) AS chars FROM f"""
SQL["unfaithful_lines"] = f"""WITH {PAIRS}, p AS (SELECT key, number, source || ' 1,234' AS source, target FROM pairs WHERE trim(target) <> ''), t AS (SELECT *, {_tokens('source')} AS st, {_tokens('target')} AS tt FROM p),
  a AS (SELECT key, number, 'number' AS kind FROM p WHERE len(list_filter({_numbers('source')}, lambda x: NOT list_contains({_numbers('target')}, x))) > 0
    UNION SELECT key, number, 'glossary' FROM t, (VALUES ('the', 'thth'), ('and', 'anan')) g(term, meaning) WHERE list_contains(st, term) AND NOT contains(lower(target), meaning)
    UNION SELECT key, number, 'short' FROM (SELECT key, number, {_letters('target')} / greatest({_letters('source')}, 1) AS ratio, median({_letters('target')} / greatest({_letters('source')}, 1)) OVER (PARTITION BY key) AS usual, count(*) OVER (PARTITION BY key) AS n FROM t WHERE len(st) >= 6 AND st <> tt) WHERE n >= 5 AND ratio < 0.4 * usual
    UNION SELECT key, number, 'echo' FROM (SELECT key, number, len(st) >= 3 AND st = tt AS echo, count(*) FILTER (len(st) >= 3 AND st = tt) OVER (PARTITION BY key) / greatest(count(*) FILTER (len(st) >= 3) OVER (PARTITION BY key), 1) AS part FROM t) WHERE echo AND part < 0.5)
  SELECT key, number, string_agg(kind, ',' ORDER BY kind) AS kinds FROM a GROUP BY key, number"""
