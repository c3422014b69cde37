"""Queries on what was heard against what was said: places, votes, matches with a truth, settings that hold together."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import picture, spelling, text
from ..operators import alignment as al
from ..operators import places as pl
from ..operators import repair as rp
from ..operators import rules as ru
from ..operators import truth as tu
from .adapters import CUES, HOUR, LINES, SPANS, cues, lines, spans, table, voices
from .dialogue import _NORM, _tokens, event_passes
from .solvers import PIECE, _passes

K = ["key"]
DAY = 24 * HOUR
S = 1_000_000


def _shown(spark, sf_dir, later_ms: int = 0):
    """Turns as cues in microseconds, shown later_ms after they are said."""
    c = cues(spark, sf_dir)
    return c.select("key", "number", "speaker", "text", ((F.col("start_ms") + later_ms) * 1000).alias("s"), ((F.col("end_ms") + later_ms) * 1000).alias("e"))


def _words(spark, sf_dir):
    """Tokens of turns with times by their number."""
    c = cues(spark, sf_dir).withColumn("t", text.tokens(F.col("text"))).withColumn("n", F.size("t"))
    c = c.select("key", "number", "speaker", F.posexplode("t").alias("at", "token"), "start_ms", "end_ms", "n")
    at = lambda k: (F.col("start_ms") * 1000 + F.floor((F.col("end_ms") - F.col("start_ms")) * 1000 * k / F.col("n"))).cast("long")
    return c.select("key", "number", "speaker", (F.col("number") * 100_000 + F.col("at")).cast("long").alias("id"), "token", at(F.col("at")).alias("s"), at(F.col("at") + 1).alias("e"))


WORDS = f"""tk AS (SELECT key, number, speaker, start_ms, end_ms, {_tokens('text')} AS t FROM cues), tu AS (SELECT key, number, speaker, start_ms, end_ms, len(t) AS n, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM tk),
  words AS (SELECT key, number, speaker, number * 100000 + pos AS id, token, start_ms * 1000 + (end_ms - start_ms) * 1000 * pos // n AS s, start_ms * 1000 + (end_ms - start_ms) * 1000 * (pos + 1) // n AS e FROM tu)"""


def placeable_lines(spark, sf_dir):
    d = spans(spark, sf_dir).withColumn("prior", (F.col("id") % 3) / 2.0)
    return pl.placeable(d).groupBy("label").agg(F.count("*").alias("n"))


def agreeing_words(spark, sf_dir):
    """Documents as words: the local languages are the document's and Arabic, the heard one hangs on its id."""
    heard = F.element_at(F.array(F.lit("en"), F.lit("fr, AR"), F.lit(""), F.lit("de")), (F.col("doc_id") % 4 + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", heard.alias("heard"))
    return pl.agreeing(d, F.col("lang"), F.col("heard")).groupBy("lang", "heard").agg(F.count("*").alias("n"))


def novel_lines(spark, sf_dir):
    """Lines of documents whose words no line before them in the document mostly has: odd lines against even ones."""
    d = lines(spark, sf_dir).withColumnRenamed("number", "line")
    return pl.novel(d.where("line % 2 = 1"), d.where("line % 2 = 0"), K).groupBy("key").agg(F.count("*").alias("n"))


def fills_needed(spark, sf_dir):
    d = spans(spark, sf_dir)
    fills = d.where("label = 'error'").select("key", "id", "s", "e")
    return pl.still_needed(fills, d.where("label <> 'error'"), K, edge_us=HOUR // 60, least_us=HOUR // 12, width=6 * HOUR).select("key", "id")


def reply_slots(spark, sf_dir):
    """Clicks set in among views; the replies are runs of ten ids."""
    d = spans(spark, sf_dir)
    return pl.slotted(d.where("label = 'view'"), d.where("label = 'click'").withColumn("block", F.floor(F.col("id") / 10)), K)


def where_said(spark, sf_dir):
    """Turns shown two and a half seconds late, against the words they are said in."""
    return pl.where_said(_shown(spark, sf_dir, 2500), _words(spark, sf_dir), K)


def misplaced_cues(spark, sf_dir):
    return pl.misplaced(where_said(spark, sf_dir), K)


def word_gaps(spark, sf_dir):
    d = spans(spark, sf_dir)
    w = d.where("label = 'view'").select("key", "id", "s", "e", F.col("label").alias("text"))
    return pl.word_gaps(d.where("label <> 'view'"), w, K, HOUR // 12, HOUR, HOUR // 2)


def sound_judged(spark, sf_dir):
    d = spans(spark, sf_dir)
    tier = F.when(F.col("label") == "click", 0).otherwise(2)
    got = pl.judged_by_sound(d.where("label = 'error'").select("key", "id", "s", "e"), d.where("label in ('click', 'view')").select("key", "s", "e", tier.alias("tier")), K, 6 * HOUR)
    return got.select("key", "id", "silent_us", "open_us", "verdict")


def moment_looks(spark, sf_dir):
    d = spans(spark, sf_dir)
    got = pl.moment_neighbours(d.where("label = 'error'").select("key", F.col("id").alias("number"), "s", "e"), d.where("label = 'view'").select("key", F.col("s").alias("at")), K, 6 * HOUR, HOUR // 60)
    return got.select("key", "number", "before", "after", "look_s", "look_e")


def steady_bands(spark, sf_dir):
    d = spans(spark, sf_dir).select("key", F.col("s").alias("at"), ((F.col("id") % 9) * 0.1).alias("top"), ((F.col("id") % 9) * 0.1 + 0.06).alias("bottom"))
    got = pl.steady_bands(d, K, apart_us=DAY)
    return got.select("key", F.round("top", 6).alias("top"), F.round("bottom", 6).alias("bottom"), "first", "last")


def copy_pieces(spark, sf_dir):
    """Turns of which an earlier or later turn of the same speaker, within a minute, says most words in order."""
    c = _shown(spark, sf_dir)
    w = _words(spark, sf_dir)
    moved = w.select("key", F.col("speaker").alias("label"), "id", "token", (F.col("s") + F.when(F.col("number") % 4 == 1, 20 * S).otherwise(900 * S)).alias("s"))
    return pl.copies(c.select("key", F.col("number").alias("id"), F.col("speaker").alias("label"), "s", "e", "text"), moved, K, 60 * S).select("key", "id")


def lead_times(spark, sf_dir):
    d = spans(spark, sf_dir)
    p = d.where("label = 'purchase'").select("key", F.col("id").alias("piece"), "s", "e")
    return pl.lead_times(p, d.where("label = 'view'"), K, 10 * HOUR, 2 * HOUR, 6 * HOUR, HOUR // 6, 0.5).select("key", "piece", "lead")


def owned_lines(spark, sf_dir):
    """Each line of a document but the first is a piece heard from the last two words of the line before on; every other one begins behind the cut."""
    d = lines(spark, sf_dir).where("text <> ''").withColumn("last", F.lag("text").over(Window.partitionBy("key").orderBy("number"))).where("last IS NOT NULL")
    said = text.words(F.col("last"))
    heard = F.array_join(F.concat(F.slice(said, F.greatest(F.lit(1), F.size(said) - 1), F.lit(2)), F.array("text")), " ")
    piece = F.col("number").alias("piece")
    mine = d.select("key", piece, F.lit(0).alias("line"), F.lit(2 * S).cast("long").alias("lead"), (F.col("number") % 2 * 3 * S).cast("long").alias("s"), F.lit(5 * S).cast("long").alias("e"), heard.alias("text"))
    before = d.select("key", piece, F.lit(0).alias("other"), F.lit(2 * S + 1).cast("long").alias("e"), F.col("last").alias("text"))
    return pl.owned_lines(mine, before, ["key", "piece"])


def cut_places(spark, sf_dir):
    """Two days around a purchase cut between views and the rest: how a label leans is its length less five."""
    d = spans(spark, sf_dir)
    w = d.select("key", "s", "e", (F.length("label") - 5).cast("double").alias("lean"))
    cuts = d.where("label = 'purchase'").select("key", "id", (F.col("s") - DAY).alias("s"), (F.col("e") + DAY).alias("e"))
    return pl.cut_places(cuts, w, K, pause_us=HOUR // 2, run_us=HOUR // 60).select("key", "id", "at")


def vote_extras(spark, sf_dir):
    return al.extra_lines(_passes(spark, sf_dir).where("pass > 0 or line % 3 <> 1"), PIECE).groupBy("key", "pass").agg(F.count("*").alias("n"))


def vote_settled(spark, sf_dir):
    w = event_passes(spark, sf_dir)
    got = al.settled(w, K, al.vote(w, K))
    return got.groupBy("key").agg(F.count("*").alias("lines"), F.count("pass").alias("fullest"))


def heard_support(spark, sf_dir):
    """Two turns of a conversation as runs; the local words are those of the first turn."""
    c = cues(spark, sf_dir).select("key", F.col("number").alias("run"), text.tokens(F.col("text")).alias("said"))
    return al.support(c, c.where("run = 0").select("key", "said"), K)


def truth_matches(spark, sf_dir):
    """Events and the seven in eight of them that were heard, with every id a word of its own."""
    d = spans(spark, sf_dir).select("key", "id", F.col("id").cast("string").alias("token"), "s")
    return tu.truth_pairs(d, d.where("id % 8 <> 3").withColumn("id", F.col("id") + 1_000_000), K)


def silence_words(spark, sf_dir):
    d = spans(spark, sf_dir)
    return tu.on_silence(d.where("label = 'error'"), d.where("label <> 'error'"), K, HOUR // 4).select("key", "id")


def turn_flips(spark, sf_dir):
    return tu.flips(spans(spark, sf_dir).withColumn("day", F.floor(F.col("s") / DAY)), K, "day", "label")


def duplicated_words(spark, sf_dir):
    """Turns shown again right behind themselves: the second showing is left over by the match.

    A turn is known by its start, and a word by that and its place, as a number may be missing or stand twice.
    """
    c = cues(spark, sf_dir).withColumn("tokens", text.tokens(F.col("text"))).withColumn("n", F.size("tokens"))
    at = lambda k: (F.col("start_ms") * 1000 + F.floor((F.col("end_ms") - F.col("start_ms")) * 1000 * k / F.col("n"))).cast("long")
    said = c.select("key", F.transform("tokens", lambda t, k: F.col("start_ms") + k).alias("ids"), "tokens", F.transform("tokens", lambda t, k: at(k)).alias("times"))
    again = c.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    ids = F.transform("tokens", lambda t, k: (F.col("start_ms") + k) * 2 + F.col("again")).alias("ids")
    shown = again.select("key", (F.col("start_ms") * 2 + F.col("again")).alias("cue"), (F.col("start_ms") * 1000).alias("s"), (F.col("end_ms") * 1000).alias("e"), ids, "tokens", "again")
    got = tu.duplicated_in(said, shown.drop("again"), shown.where("again = 0").select("key", "ids"), K)
    return got.groupBy("key").agg(F.count("*").alias("twice"))


def sentence_edges(spark, sf_dir):
    """Days of a user as sentences from the first view on; errors were not heard."""
    d = spans(spark, sf_dir).withColumn("line", F.floor(F.col("s") / DAY))
    sentences = d.groupBy("key", "line").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    heard = lambda c: F.when(F.col("label") != "error", F.col(c) + HOUR)
    return tu.sentence_edges(sentences, d.select("key", "line", F.struct("s", "id").alias("seq"), heard("s").alias("s"), heard("e").alias("e")), K, HOUR // 2)


def edge_report(spark, sf_dir):
    return tu.edge_report(sentence_edges(spark, sf_dir), K, HOUR // 2)


def verdict_rollup(spark, sf_dir):
    d = spans(spark, sf_dir).withColumn("owner", F.floor(F.col("id") / 500))
    got = tu.rollup(d, K, "label", "owner")
    return got.select("key", "lines", F.array_join(F.transform(F.map_entries("verdicts"), lambda x: F.concat_ws(":", x["key"], x["value"])), ",").alias("verdicts"), "owner")


def echo_lines(spark, sf_dir):
    """The first two words of a turn as a line, against the words said near it."""
    c = _shown(spark, sf_dir).withColumn("text", F.array_join(F.slice(text.words(F.col("text")), 1, 2), " "))
    w = _words(spark, sf_dir).where("id % 3 > 0")
    return rp.echoes(c.select("key", F.col("number").alias("line"), "s", "e", "text"), w, K, S).select("key", "line")


def seam_places(spark, sf_dir):
    """Embeddings as windows of ten clips in the order of their ids; the voice changes every 20 windows."""
    d = voices(spark, sf_dir)
    turn = F.floor(F.col("id") / 200) % 4
    vec = F.transform("vec", lambda x, i: x * 0.05 + F.when(i == turn, 1.0).otherwise(0.0))
    return rp.seams(d.select((F.col("id") % 10).alias("clip"), "id", F.col("id").alias("s"), vec.alias("vec")), ["clip"], 0.6)


def _settings(spark, sf_dir):
    """Parts as settings: sizes, prices and names decide the values."""
    k = F.col("p_partkey")
    hexed = lambda m: F.concat(F.lit("#"), F.lpad(F.lower(F.hex((k * m) % 16777216)), 6, "0"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        (k % 7 / 2.0).alias("min_duration"), (k % 5 / 1.5).alias("min_readable"), (k % 4 / 2.0).alias("long_pause"), (k % 3 / 2.0).alias("join_gap"), (k % 6 / 10.0).alias("min_gap"),
        F.when(k % 2 == 0, "box").otherwise("outline").alias("style"), (k % 3 == 0).alias("speaker_colours"), hexed(7919).alias("box_colour"), F.lit("#141414").alias("outline_colour"), F.lit("#ffe066,#8fe3f5").alias("speaker_palette"), (k % 101).cast("double").alias("box_opacity"), F.lit("#f7f5f0").alias("text_colour"),
        (k % 40).cast("double").alias("padding"), (k % 20).cast("double").alias("side_margin"), (80 + k % 9 * 5).cast("double").alias("size"), (30 + k % 30).cast("int").alias("line_chars"), F.lit(0.55).alias("char_em"), (k % 2 == 0).alias("one_line"), (k % 3 == 0).alias("dialogue_cues"),
    )


def settings_broken(spark, sf_dir):
    return ru.broken(_settings(spark, sf_dir), ["p_partkey"]).groupBy("rule").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


def settings_fallen(spark, sf_dir):
    got = ru.fallen_back(_settings(spark, sf_dir), {"min_readable": 9.0, "join_gap": -1.0, "min_gap": 0.0, "one_line": False}, ["readable", "joins", "gaps", "one_line"])
    return got.select("p_partkey", "min_readable", "join_gap", "min_gap", "one_line")


def settings_nearest(spark, sf_dir):
    d = _settings(spark, sf_dir).select("p_partkey", "min_duration", "min_readable", "min_gap")
    return ru.nearest_holding(d, "min_gap", 0.0, 0.6, 0.05, ["gaps", "readable"]).select("p_partkey", "min_gap", "nearest")


def presets_laid(spark, sf_dir):
    k = F.col("p_partkey")
    entry = lambda n, c: F.when(c, F.struct(F.lit(n).alias("k"), F.concat(F.lit("v"), k % 3).alias("v")))
    stored = F.map_from_entries(F.array_compact(F.array(entry("a", k % 2 == 0), entry("b", k % 3 > 0), entry("keep", k % 5 > 0))))
    maps = lambda **kv: F.create_map(*[x for n, v in kv.items() for x in (F.lit(n), F.lit(v))])
    defaults, preset = maps(a="v0", b="v1", c="v0", keep="v9"), maps(b="v2", c="v5", keep="v7")
    laid = ru.laid_over(stored, preset, defaults, ["keep"])
    told = lambda m: F.array_join(F.transform(F.sort_array(F.map_entries(m)), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return table(spark, sf_dir, "part").select("p_partkey", told(laid).alias("laid"), ru.active(stored, {"mine": preset, "plain": maps(a="v0")}, defaults, ["keep"]).alias("active"))


def prefs_migrated(spark, sf_dir):
    """Older settings under their new names; a stored text that can't be read has no values."""
    k = F.col("p_partkey")
    old = F.create_map(F.lit("size"), (k % 4).cast("string"), F.lit("font"), F.when(k % 3 == 0, "").otherwise("Serif"))
    allowed = F.create_map(F.lit("look.size"), F.array(F.lit("1"), F.lit("2"), F.lit("3")))
    got = ru.migrated(old, {"size": "look.size", "font": "look.font"}, allowed, F.create_map(F.lit("look.size"), F.lit("1")))
    raw = F.when(k % 4 == 0, "{broken").otherwise(F.concat(F.lit('{"values": {"a": "'), k % 7, F.lit('"}, "presets": {"p": {"b": "1"}}}')))
    kept = ru.kept_from(raw)
    told = lambda m: F.array_join(F.transform(F.sort_array(F.map_entries(m)), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return table(spark, sf_dir, "part").select("p_partkey", told(got).alias("moved"), told(kept["values"]).alias("kept"), F.size(kept["presets"]).cast("long").alias("presets"))


def picture_fit(spark, sf_dir):
    k = F.col("p_partkey")
    w, h = (240 + k % 50 * 40).cast("int"), F.when(k % 3 == 0, 1920).otherwise(1080)
    size, side, pad = (80 + k % 9 * 5).cast("double"), (k % 21).cast("double"), (k % 41).cast("double")
    font = picture.font_size(w, h, size)
    fit = picture.fitted(F.lit(42), F.lit(84), w, h, size, side, pad, F.lit(0.55))
    return table(spark, sf_dir, "part").select("p_partkey", font.alias("font"), picture.margin(w, side).alias("side"), picture.padding(font, pad).alias("padding"), picture.outline(font, pad, k % 2 == 0).alias("outline"), picture.gap(pad).alias("gap"), fit["line_chars"].alias("line_chars"), fit["source_chars"].alias("source_chars"))


def number_words(spark, sf_dir):
    """Keys and prices as they are spoken, and a number whose thousands are words of their own."""
    k = F.col("p_partkey")
    parts = F.array(F.concat(F.lit("x"), k), F.lit("200"), F.lit("300."), F.lit("and"), F.lit("400"))
    return table(spark, sf_dir, "part").select("p_partkey", spelling.english(k * 1009).alias("spoken"), spelling.said(F.concat(F.lit("a 4,000 b "), k, F.lit(" c"))).alias("said"), F.array_join(spelling.joined(parts), "|").alias("joined"))


QUERIES = {f.__name__: f for f in (placeable_lines, agreeing_words, novel_lines, fills_needed, reply_slots, where_said, misplaced_cues, word_gaps, sound_judged, moment_looks, steady_bands, copy_pieces, lead_times, owned_lines, cut_places, vote_extras, vote_settled, heard_support, truth_matches, silence_words, turn_flips, duplicated_words, sentence_edges, edge_report, verdict_rollup, echo_lines, seam_places, settings_broken, settings_fallen, settings_nearest, presets_laid, prefs_migrated, picture_fit, number_words)}

_W = "PARTITION BY key ORDER BY s, e, id"
_WHERE = f"""{CUES}, {WORDS}, g AS (SELECT key, s, token AS a, lead(token) OVER o AS b, lead(token, 2) OVER o AS c FROM words WINDOW o AS (PARTITION BY key ORDER BY s, id)),
  q AS (SELECT key, number, (start_ms + 2500) * 1000 AS s, (end_ms + 2500) * 1000 AS e, {_tokens('text')} AS t FROM cues),
  p AS (SELECT key, number, s, e, i, t[i] AS a, t[i + 1] AS b, t[i + 2] AS c FROM q, (VALUES (1), (2), (3)) v(i) WHERE len(t) > 3 AND i + 2 <= len(t)),
  j AS (SELECT p.key, p.number, p.i, g.s AS ws, p.s - g.s - 300000 * (p.i - 1) AS shift FROM p JOIN g ON g.key = p.key AND g.a = p.a AND g.b = p.b AND g.c = p.c AND g.s BETWEEN p.s - 40000000 AND p.e + 40000000),
  r AS (SELECT key, number, shift, row_number() OVER (PARTITION BY key, number ORDER BY abs(shift), i, ws) AS k FROM j), placed AS (SELECT key, number, shift FROM r WHERE k = 1)"""
_ISLANDS = """{n}o AS (SELECT key, s, e, max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ({src})),
  {n}g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM {n}o), {n} AS (SELECT key, min(s) AS s, max(e) AS e FROM {n}g GROUP BY key, g)"""
_EDGES = f"""{SPANS}, d AS (SELECT *, s // {DAY} AS line FROM spans), t AS (SELECT key, line, min(s) AS ts, max(e) AS te FROM d GROUP BY ALL),
  h AS (SELECT d.key, d.line, d.s AS o, d.id, CASE WHEN label <> 'error' THEN d.s + {HOUR} END AS hs, CASE WHEN label <> 'error' THEN d.e + {HOUR} END AS he, ts, te FROM d JOIN t USING (key, line)),
  edges AS (SELECT key, line, count(hs) AS held, count(*) FILTER ((hs + he) / 2 < ts - {HOUR // 2} OR (hs + he) / 2 > te + {HOUR // 2}) AS outside, arg_min_null(hs - ts, (o, id)) AS first, arg_max_null(he - te, (o, id)) AS last FROM h GROUP BY key, line HAVING count(hs) > 0)"""

SQL = {
    "placeable_lines": "SELECT event_type AS label, count(*) AS n FROM events WHERE event_id % 3 > 0 GROUP BY event_type",
    "agreeing_words": """WITH d AS (SELECT lang, ['en', 'fr, AR', '', 'de'][doc_id % 4 + 1] AS heard FROM documents)
  SELECT lang, heard, count(*) AS n FROM d WHERE lang IS NULL OR heard = '' OR lang = heard OR (heard = 'fr, AR' AND lang IN ('fr', 'ar')) GROUP BY ALL""",
    "novel_lines": f"""WITH {LINES}, t AS (SELECT key, number, list_distinct({_tokens('text')}) AS t FROM lines), w AS (SELECT key, number, len(t) AS n, unnest(t) AS token FROM t),
  m AS (SELECT a.key, a.number, a.n, b.number AS other, count(*) AS same FROM w a JOIN w b ON a.key = b.key AND a.token = b.token AND a.number % 2 = 1 AND b.number % 2 = 0 GROUP BY ALL)
  SELECT key, count(*) AS n FROM t WHERE number % 2 = 1 AND len(t) > 0 AND NOT EXISTS (SELECT 1 FROM m WHERE m.key = t.key AND m.number = t.number AND m.same >= 0.6 * m.n) GROUP BY key""",
    "fills_needed": f"""WITH {SPANS}, {_ISLANDS.format(n='i', src=f"SELECT key, s - {HOUR // 60} AS s, e + {HOUR // 60} AS e FROM spans WHERE label <> 'error'")},
  f AS (SELECT p.key, p.id, p.e - p.s AS len, sum(CASE WHEN i.s IS NULL THEN 0 ELSE least(p.e, i.e) - greatest(p.s, i.s) END) AS us FROM spans p LEFT JOIN i ON i.key = p.key AND i.s < p.e AND p.s < i.e WHERE label = 'error' GROUP BY ALL)
  SELECT key, id FROM f WHERE len - us >= least({HOUR // 12}, len)""",
    "reply_slots": f"""WITH {SPANS}, h AS (SELECT key, id // 10 AS block, min(s) AS hd FROM spans WHERE label = 'click' GROUP BY ALL),
  t AS (SELECT key, id, NULL::BIGINT AS block, s AS hd, row_number() OVER (PARTITION BY key ORDER BY s, id) AS slot, 0 AS kind FROM spans WHERE label = 'view'),
  r AS (SELECT p.key, p.id, h.block, h.hd, (SELECT count(*) FROM spans v WHERE v.key = h.key AND v.label = 'view' AND v.s <= h.hd) AS slot, 1 AS kind FROM spans p JOIN h ON h.key = p.key AND h.block = p.id // 10 WHERE p.label = 'click')
  SELECT key, id, block, CAST(row_number() OVER (PARTITION BY key ORDER BY slot, kind, hd, block, id) AS INTEGER) AS place FROM (SELECT * FROM t UNION ALL SELECT * FROM r)""",
    "where_said": f"WITH {_WHERE} SELECT * FROM placed",
    "misplaced_cues": f"WITH {_WHERE} SELECT key, count(*) FILTER (abs(shift) >= 2000000) AS misplaced, count(*) AS placed FROM placed GROUP BY key",
    "sound_judged": f"""WITH {SPANS}, j AS (SELECT p.key, p.id, CAST(sum(CASE WHEN t.label = 'click' THEN least(p.e, t.e) - greatest(p.s, t.s) ELSE 0 END) AS BIGINT) AS silent_us, CAST(sum(CASE WHEN t.label = 'view' THEN least(p.e, t.e) - greatest(p.s, t.s) ELSE 0 END) AS BIGINT) AS open_us
    FROM spans p LEFT JOIN spans t ON t.key = p.key AND t.label IN ('click', 'view') AND t.s < p.e AND p.s < t.e WHERE p.label = 'error' GROUP BY ALL),
  n AS (SELECT key, id, CASE WHEN EXISTS (SELECT 1 FROM spans t, spans p WHERE p.id = j.id AND t.key = p.key AND t.label IN ('click', 'view') AND t.s < p.e AND p.s < t.e) THEN silent_us END AS silent_us, CASE WHEN EXISTS (SELECT 1 FROM spans t, spans p WHERE p.id = j.id AND t.key = p.key AND t.label IN ('click', 'view') AND t.s < p.e AND p.s < t.e) THEN open_us END AS open_us FROM j)
  SELECT *, CASE WHEN silent_us IS NULL THEN 'unchecked' WHEN open_us / (open_us + silent_us) < 0.3 THEN 'silence' ELSE 'speech' END AS verdict FROM n""",
    "moment_looks": f"""WITH {SPANS}, c AS (SELECT key, id AS number, s, e, least({HOUR // 60}, (e - s) // 2) AS edge FROM spans WHERE label = 'error')
  SELECT key, number, (SELECT max(v.s) FROM spans v WHERE v.key = c.key AND v.label = 'view' AND v.s < c.s AND v.s >= c.s - {6 * HOUR}) AS before, (SELECT min(v.s) FROM spans v WHERE v.key = c.key AND v.label = 'view' AND v.s > c.e AND v.s <= c.e + {6 * HOUR}) AS after, s + edge AS look_s, e - edge AS look_e FROM c""",
    "steady_bands": f"""WITH {SPANS}, b AS (SELECT key, id % 9 AS g, min(s) AS first, max(s) AS last FROM spans GROUP BY ALL) SELECT key, round(g * 0.1, 6) AS top, round(g * 0.1 + 0.06, 6) AS bottom, first, last FROM b WHERE last - first >= {DAY}""",
    "lead_times": f"""WITH {SPANS}, {_ISLANDS.format(n='i', src="SELECT key, s, e FROM spans WHERE label = 'view'")}, p AS (SELECT key, id AS piece, s, lag(s) OVER (PARTITION BY key ORDER BY id) AS last FROM spans WHERE label = 'purchase'),
  u AS (SELECT p.key, p.piece, p.s, p.last, sum(CASE WHEN i.s IS NULL THEN 0 ELSE least(p.s, i.e) - greatest(p.s - {2 * HOUR}, i.s) END) AS us FROM p LEFT JOIN i ON i.key = p.key AND i.s < p.s AND i.e > p.s - {2 * HOUR} GROUP BY ALL)
  SELECT key, piece, CASE WHEN last IS NULL THEN 0 ELSE least(CASE WHEN us < {HOUR // 6} THEN {6 * HOUR} ELSE {2 * HOUR} END, {5 * HOUR}, s - last) END AS lead FROM u""",
    "owned_lines": f"""WITH {LINES}, l AS (SELECT key, number, text, lag(text) OVER (PARTITION BY key ORDER BY number) AS last FROM lines WHERE text <> ''),
  h AS (SELECT key, number AS piece, regexp_extract_all(array_to_string(list_concat(regexp_extract_all(last, '\\S+')[-2:], [text]), ' '), '\\S+') AS w, regexp_extract_all(last, '\\S+') AS o, number % 2 * 3000000 AS s, array_to_string(list_concat(regexp_extract_all(last, '\\S+')[-2:], [text]), ' ') AS text FROM l WHERE last IS NOT NULL),
  t AS (SELECT key, piece, list_transform(w, lambda x: CASE WHEN {_NORM.format(w='x')} = '' THEN x ELSE {_NORM.format(w='x')} END) AS a, list_transform(o, lambda x: CASE WHEN {_NORM.format(w='x')} = '' THEN x ELSE {_NORM.format(w='x')} END) AS b FROM h WHERE s = 0),
  x AS (SELECT key, piece, len(a) AS n, len(b) AS m, unnest(a) AS token, generate_subscripts(a, 1) - 1 AS i FROM t), y AS (SELECT key, piece, unnest(b) AS token, generate_subscripts(b, 1) - 1 AS j FROM t),
  g AS (SELECT x.key, x.piece, n, m, j - i + k AS off, max(i) + 1 AS held, count(DISTINCT i) AS same, max(j) AS last FROM x JOIN y USING (key, piece, token), (VALUES (-1), (0), (1)) v(k) GROUP BY ALL),
  f AS (SELECT key, piece, max(held) AS held FROM g WHERE (held = n OR last + 1 >= m - 1) AND same >= 0.6 * held GROUP BY key, piece),
  r AS (SELECT h.*, CASE WHEN s = 0 THEN coalesce(held, 0) ELSE 0 END AS n, CASE WHEN s = 0 THEN greatest((5000000 * coalesce(held, 0)) // greatest(len(w), 1), 2000000) - 2000000 ELSE 1000000 END AS begins FROM h LEFT JOIN f USING (key, piece))
  SELECT key, piece, 0 AS line, CAST(begins AS BIGINT) AS s, CAST(greatest(begins, 3000000) AS BIGINT) AS e, CASE WHEN n > 0 THEN array_to_string(w[n + 1:], ' ') ELSE text END AS text FROM r WHERE s > 0 OR n < len(w)""",
    "cut_places": f"""WITH {SPANS}, d AS (SELECT key, s, e, length(label) - 5 AS lean FROM spans),
  r AS (SELECT key, e, sum(CASE WHEN e - s >= {HOUR // 60} THEN lean * (e - s) / 1e6 ELSE 0 END) OVER (o ROWS UNBOUNDED PRECEDING) AS upto, lead(s) OVER o AS nxt FROM d WINDOW o AS (PARTITION BY key ORDER BY s, e, lean)),
  p AS (SELECT key, e AS s, nxt AS e, upto FROM r WHERE nxt - e >= {HOUR // 2}), c AS (SELECT key, id, s - {DAY} AS s, e + {DAY} AS e FROM spans WHERE label = 'purchase'),
  j AS (SELECT c.key, c.id, (p.s + p.e) // 2 AS at, row_number() OVER (PARTITION BY c.key, c.id ORDER BY round(upto, 6) DESC, p.e - p.s DESC, p.s) AS k FROM c JOIN p ON p.key = c.key AND p.s < c.e AND c.s < p.e)
  SELECT c.key, c.id, j.at FROM c LEFT JOIN j ON j.key = c.key AND j.id = c.id AND k = 1""",
    "truth_matches": f"WITH {SPANS} SELECT key, id, id + 1000000 AS heard_id FROM spans WHERE id % 8 <> 3",
    "silence_words": f"""WITH {SPANS}, w AS (SELECT key, id, (s + e) // 2 AS m FROM spans WHERE label = 'error')
  SELECT key, id FROM w WHERE NOT EXISTS (SELECT 1 FROM spans o WHERE o.key = w.key AND o.label <> 'error' AND ((o.s <= m AND o.e >= m - {HOUR // 4}) OR (o.s > m AND o.s <= m + {HOUR // 4})))""",
    "turn_flips": f"""WITH {SPANS}, d AS (SELECT key, label <> lag(label) OVER (PARTITION BY key, s // {DAY} ORDER BY id) AS flip FROM spans) SELECT key, count(*) FILTER (flip) AS flips FROM d GROUP BY key""",
    "sentence_edges": f"WITH {_EDGES} SELECT * FROM edges",
    "edge_report": f"""WITH {_EDGES}, x AS (SELECT *, list_filter([abs(first), abs(last)], lambda v: v IS NOT NULL) AS v FROM edges)
  SELECT key, count(*) AS sentences, CAST(sum(len(v)) AS BIGINT) AS edges, CAST(sum(len(list_filter(v, lambda a: a > {HOUR // 2}))) AS BIGINT) AS edge_over, max(list_max(v)) AS edge_worst, count(*) FILTER (first > {HOUR // 2}) AS late, count(*) FILTER (first < -{HOUR // 2}) AS early FROM x GROUP BY key""",
    "verdict_rollup": f"""WITH {SPANS}, n AS (SELECT key, label, count(*) AS n FROM spans GROUP BY ALL), c AS (SELECT key, CAST(sum(n) AS BIGINT) AS lines, string_agg(label || ':' || n, ',' ORDER BY label) AS verdicts FROM n GROUP BY key),
  o AS (SELECT key, id // 500 AS owner, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, id // 500) AS k FROM spans GROUP BY key, id // 500) SELECT c.key, lines, verdicts, owner FROM c JOIN o ON o.key = c.key AND k = 1""",
    "settings_fallen": """WITH s AS (SELECT p_partkey AS k, p_partkey % 7 / 2.0 AS d, p_partkey % 5 / 1.5 AS r, p_partkey % 4 / 2.0 AS p, p_partkey % 3 / 2.0 AS j, p_partkey % 6 / 10.0 AS g FROM part)
  SELECT k AS p_partkey, CASE WHEN r >= d - 1e-9 THEN r ELSE 9.0 END AS min_readable, CASE WHEN j < p - 1e-9 THEN j ELSE -1.0 END AS join_gap, CASE WHEN g <= d / 4 + 1e-9 THEN g ELSE 0.0 END AS min_gap, k % 2 = 0 AND k % 3 <> 0 AS one_line FROM s""",
    "settings_nearest": """WITH s AS (SELECT p_partkey AS k, p_partkey % 7 / 2.0 AS d, p_partkey % 5 / 1.5 AS r, p_partkey % 6 / 10.0 AS g FROM part), t AS (SELECT k, d, r, g, round(i * 0.05, 4) AS v FROM s, range(13) u(i)),
  n AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY abs(v - g), v) AS o FROM t WHERE v <= d / 4 + 1e-9 AND r >= d - 1e-9) SELECT s.k AS p_partkey, g AS min_gap, n.v AS nearest FROM s LEFT JOIN n ON n.k = s.k AND o = 1""",
    "settings_broken": """WITH s AS (SELECT p_partkey AS k, p_partkey % 7 / 2.0 AS d, p_partkey % 5 / 1.5 AS r, p_partkey % 4 / 2.0 AS p, p_partkey % 3 / 2.0 AS j, p_partkey % 6 / 10.0 AS g, '#' || lpad(lower(to_hex((p_partkey * 7919) % 16777216)), 6, '0') AS box, p_partkey % 101 AS op, 80 + p_partkey % 9 * 5 AS size, p_partkey % 20 AS side, p_partkey % 40 AS pad, 30 + p_partkey % 30 AS chars FROM part),
  h AS (SELECT k, CASE WHEN k % 2 = 0 THEN [255, 0] END AS ground, [CAST(('0x' || box[2:3]) AS INTEGER), CAST(('0x' || box[4:5]) AS INTEGER), CAST(('0x' || box[6:7]) AS INTEGER)] AS b, op FROM s),
  m AS (SELECT k, CASE WHEN ground IS NULL THEN [[20, 20, 20]] ELSE list_transform(ground, lambda w: list_transform(b, lambda x: CAST(round_even(x * op / 100.0 + w * (1 - op / 100.0), 0) AS INTEGER))) END AS behind FROM h),
  c AS (SELECT k, unnest(behind) AS rgb, false AS shown FROM m),
  l AS (SELECT k, list_transform(rgb, lambda x: CASE WHEN x / 255 <= 0.04045 THEN x / 255 / 12.92 ELSE pow((x / 255 + 0.055) / 1.055, 2.4) END) AS q FROM c), y AS (SELECT k, 0.2126 * q[1] + 0.7152 * q[2] + 0.0722 * q[3] AS y FROM l),
  f AS (SELECT hex, list_transform([2, 4, 6], lambda i: CAST(('0x' || hex[i:i+1]) AS INTEGER) / 255) AS p, third FROM (VALUES ('#f7f5f0', false), ('#ffe066', true), ('#8fe3f5', true)) v(hex, third)),
  fy AS (SELECT third, list_transform(p, lambda x: CASE WHEN x <= 0.04045 THEN x / 12.92 ELSE pow((x + 0.055) / 1.055, 2.4) END) AS q FROM f), fz AS (SELECT third, 0.2126 * q[1] + 0.7152 * q[2] + 0.0722 * q[3] AS z FROM fy),
  bad AS (SELECT DISTINCT y.k FROM y, fz WHERE (NOT third OR y.k % 3 = 0) AND (greatest(y, z) + 0.05) / (least(y, z) + 0.05) < 4.5),
  w AS (SELECT k, chars, size, side, pad, CAST(round_even(1080 * 0.058 * size / 100.0, 0) AS INTEGER) AS font FROM s), v AS (SELECT k, chars, (1920 - 2 * CAST(round_even(1920 * side / 100.0, 0) AS INTEGER) - 2 * greatest(4, CAST(round_even(font * pad / 100.0, 0) AS INTEGER))) / (font * 0.55::DOUBLE) AS widest FROM w),
  a AS (SELECT 'readable' AS rule, k FROM s WHERE r < d - 1e-9 UNION ALL SELECT 'joins', k FROM s WHERE j >= p - 1e-9 UNION ALL SELECT 'gaps', k FROM s WHERE g > d / 4 + 1e-9 UNION ALL SELECT 'contrast', k FROM bad
    UNION ALL SELECT 'width', k FROM v WHERE chars > trunc(widest) UNION ALL SELECT 'one_line', k FROM s WHERE k % 2 = 0 AND k % 3 = 0)
  SELECT rule, count(*) AS n, min(k) AS first FROM a GROUP BY rule""",
    "presets_laid": """WITH s AS (SELECT p_partkey AS k, 'v' || p_partkey % 3 AS v FROM part)
  SELECT k AS p_partkey, array_to_string(list_filter([CASE WHEN k % 2 = 0 THEN 'a=' || v END, 'b=v2', 'c=v5', CASE WHEN k % 5 > 0 THEN 'keep=' || v END], lambda x: x IS NOT NULL), ',') AS laid,
    CASE WHEN k % 2 <> 0 AND k % 3 = 0 THEN 'plain' ELSE '' END AS active FROM s""",
    "prefs_migrated": """SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 3 > 0 THEN 'look.font=Serif' END, CASE WHEN p_partkey % 4 > 1 THEN 'look.size=' || p_partkey % 4 END], lambda x: x IS NOT NULL), ',') AS moved,
    CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'a=' || p_partkey % 7 END AS kept, CAST(CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 1 END AS BIGINT) AS presets FROM part""",
    "picture_fit": """WITH s AS (SELECT p_partkey AS k, 240 + p_partkey % 50 * 40 AS w, CASE WHEN p_partkey % 3 = 0 THEN 1920 ELSE 1080 END AS h, 80 + p_partkey % 9 * 5 AS size, p_partkey % 21 AS side, p_partkey % 41 AS pad FROM part),
  f AS (SELECT *, CAST(round_even(least(w, h) * CASE WHEN h > w THEN 0.066 ELSE 0.058 END * size / 100, 0) AS INTEGER) AS font FROM s),
  m AS (SELECT *, CAST(round_even(w * side / 100.0, 0) AS INTEGER) AS sm, round_even(CAST(font * pad / 100.0 AS DOUBLE), 1) AS pd FROM f),
  l AS (SELECT *, greatest(8, least(42, CAST(trunc((w - 2 * sm - 2 * pd) / (font * 0.55::DOUBLE)) AS INTEGER))) AS line FROM m)
  SELECT k AS p_partkey, font, sm AS side, pd AS padding, CASE WHEN k % 2 = 0 THEN round_even(CAST(font * 0.06 AS DOUBLE), 1) ELSE CAST(greatest(2, CAST(round_even(font * pad / 100.0, 0) AS INTEGER)) AS DOUBLE) END AS outline,
    greatest(0.3, round_even(CAST(pad / 100.0 + 0.08 AS DOUBLE), 4)) AS gap, CAST(line AS INTEGER) AS line_chars, CAST(CASE WHEN line < 42 THEN greatest(8, 84 * line // 42) ELSE 84 END AS INTEGER) AS source_chars FROM l""",
}
