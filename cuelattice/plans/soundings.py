"""Queries on letters in the sound, speakers over pieces, voices that settle, and the ledger of requests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import chains as ch
from ..operators import places as pl
from ..operators import sound as so
from ..streaming import ledger as le
from .adapters import HOUR, SPANS, spans, voices

K = ["key"]
CLIP = ["clip"]
DAY = 24 * HOUR
S = 1_000_000


def _emissions(spark, sf_dir):
    """Vectors in the order of their ids as frames: 50 to a clip, five symbols by their first five places."""
    v = voices(spark, sf_dir)
    loud = F.transform(F.slice("vec", 1, 5), lambda x: F.exp(8 * x))
    total = F.aggregate(loud, F.lit(0.0), lambda s, x: s + x)
    return v.select(F.floor(F.col("id") / 50).alias("clip"), (F.col("id") % 50).alias("frame"), F.transform(loud, lambda x: F.log(x / total)).alias("logp"))


def tolerant_words(spark, sf_dir):
    """Three words in every clip's frames, with stars and words left out."""
    words = F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3)), F.array(F.lit(4), F.lit(1), F.lit(2)))
    d = _emissions(spark, sf_dir).withColumn("words", words)
    return so.tolerant_alignment(d, CLIP, so.Tolerance(delta=0.5, enter=1.0, skip=1.5), least=3)


def lines_by_sound(spark, sf_dir):
    """Two lines a clip, at its beginning and its end, moved to where the frames hold them better."""
    e = _emissions(spark, sf_dir)
    clips = e.select("clip").distinct()
    line = lambda n, letters, a, b: F.struct(F.lit(n).alias("line"), F.array(*map(F.lit, letters)).alias("letters"), F.lit(a).cast("long").alias("from"), F.lit(b).cast("long").alias("upto"))
    lines = clips.select("clip", F.explode(F.array(line(0, [1, 2, 3], 0, 9), line(1, [4, 3], 40, 49))).alias("x")).select("clip", "x.*")
    return so.sound_moves(lines, so.free_places(lines, e, CLIP), CLIP, reach=5, few=3, least=0.2, better=0.05).select("clip", "line", "first", "last", "moved")


def speakers_over_pieces(spark, sf_dir):
    """Days of a user as pieces, types of events as labels; two labels are linked by events of both days at the same quarter of the day."""
    d = spans(spark, sf_dir).select("key", F.floor(F.col("s") / DAY).alias("day"), "label", F.floor(F.col("s") % DAY / (6 * HOUR)).alias("quarter"))
    d = d.withColumn("piece", (F.col("day") - F.min("day").over(_by_key())).cast("long"))
    last = d.select("key", (F.col("piece") + 1).alias("piece"), "quarter", F.col("label").alias("before"))
    counts = d.join(last, ["key", "piece", "quarter"]).groupBy("key", "piece", "label", "before").agg(F.count("*").alias("n"))
    return ch.piece_names(ch.piece_maps(counts, d.select("key", "piece", "label").distinct(), K), K)


def _by_key():
    return Window.partitionBy("key")


def voices_settled(spark, sf_dir):
    """Vectors as windows of clips of 250, eight to a turn, under their labels."""
    d = voices(spark, sf_dir).withColumns({"clip": F.floor(F.col("id") / 250), "turn": F.floor(F.col("id") / 8), "label": F.col("label").cast("string")})
    return ch.settled_voices(d, CLIP)


def asked_ledger(spark, sf_dir):
    """Events as stretches asked about again, three days a job; errors fail, and every hundredth purchase uses the quota up."""
    d = spans(spark, sf_dir)
    outcome = F.when(F.col("label") == "error", "failed").when((F.col("label") == "purchase") & (F.col("id") % 100 == 0), "quota").otherwise("answered")
    first = F.min("s").over(_by_key())
    asks = d.select("key", F.struct("s", "id").alias("order"), F.floor((F.col("s") - first) / (3 * DAY)).alias("job"), ((F.col("s") - first) % DAY).alias("s"), (F.col("e") - F.col("s")).alias("long"), outcome.alias("outcome"))
    asks = asks.select("key", F.row_number().over(_by_key().orderBy("order")).cast("long").alias("seq"), "job", "s", (F.col("s") + F.col("long")).alias("e"), "outcome")
    return le.ledger(asks, K, le.Rules(budget=12 * HOUR))


def lines_placed(spark, sf_dir):
    """Days of a user as pieces of 90 seconds, events as lines at times made of their ids; what an event says is its type and a number."""
    d = spans(spark, sf_dir)
    at = F.col("id") * 37 % 160
    d = d.select("key", F.floor(F.col("s") / DAY).alias("piece"), F.col("id").alias("line"), (at * S).alias("s"), ((at + F.col("id") % 9 + 1) * S).alias("e"), F.concat_ws(" ", "label", F.col("id") % 50).alias("text"), F.lit(90 * S).cast("long").alias("length"))
    return pl.placed_lines(d, ["key", "piece"]).select("key", "piece", "line", "s", "e", "verdict")


def passes_read_back(spark, sf_dir):
    """Weeks of a user as requests of 110 seconds, heard in three passes by the ids' remainders; the first of them says no time between 60 and 100 s."""
    d = spans(spark, sf_dir)
    at = F.when(F.col("id") % 3 == 0, F.element_at(F.array(*map(F.lit, (5, 40, 58, 103, 105))), (F.col("id") % 5 + 1).cast("int"))).otherwise(F.col("id") * 37 % 110)
    d = d.select("key", F.floor(F.col("s") / (7 * DAY)).alias("week"), (F.col("id") % 3).alias("pass"), F.col("id").alias("line"), (at * S).cast("long").alias("s"), ((at + F.when(at == 58, 46).otherwise(2)) * S).cast("long").alias("e"), F.repeat(F.lit("x"), (F.col("id") % 400).cast("int")).alias("text"), F.lit(110 * S).cast("long").alias("length"))
    return pl.read_back_passes(d, ["key", "week"]).select("key", "week", "pass", "line", "s", "e", "back")


QUERIES = {f.__name__: f for f in (tolerant_words, lines_by_sound, speakers_over_pieces, voices_settled, asked_ledger, lines_placed, passes_read_back)}

_UNDONE = "CASE WHEN {t} % 100000000 < 60000000 THEN {t} // 100000000 * 60000000 + {t} % 100000000 END"
SQL = {
    "lines_placed": f"""WITH {SPANS}, b AS (SELECT key, s // {DAY} AS piece, id AS line, id * 37 % 160 * 1000000 AS s, (id * 37 % 160 + id % 9 + 1) * 1000000 AS e, label, id % 50 AS n FROM spans),
  t AS (SELECT *, s < 91000000 AS inn, {_UNDONE.format(t='s')} AS bs, {_UNDONE.format(t='e')} AS bn FROM b),
  w AS (SELECT *, coalesce(last_value(CASE WHEN inn THEN CASE WHEN e >= 91000000 THEN s ELSE e END END IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low,
    coalesce(first_value(CASE WHEN inn THEN s END IGNORE NULLS) OVER (o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 91000000) AS nxt FROM t WINDOW o AS (PARTITION BY key, piece ORDER BY line)),
  x AS (SELECT *, greatest(bs, least(CASE WHEN bn >= bs THEN bn ELSE bs + e - s END, 91000000)) AS be FROM w),
  y AS (SELECT *, coalesce(NOT inn AND bs >= low AND bs <= 90000000 AND be <= nxt, false) AS may FROM x),
  z AS (SELECT *, may AND bs >= coalesce(max(CASE WHEN may THEN be END) OVER (PARTITION BY key, piece, low, nxt ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS slip FROM y),
  v AS (SELECT z.*, NOT EXISTS (SELECT 1 FROM z o WHERE o.key = z.key AND o.piece = z.piece AND o.inn AND o.label = z.label AND o.n = z.n) AS fresh FROM z)
  SELECT key, piece, line, CASE WHEN inn THEN s WHEN slip THEN bs WHEN fresh THEN 90700000 END AS s,
    CASE WHEN inn THEN CASE WHEN e <= 91000000 THEN e WHEN bn BETWEEN s AND 91000000 THEN bn ELSE 91000000 END WHEN slip THEN be WHEN fresh THEN 91000000 END AS e,
    CASE WHEN inn THEN 'inside' WHEN slip THEN 'slipped' WHEN fresh THEN 'edge' ELSE 'invented' END AS verdict FROM v""",
    "passes_read_back": f"""WITH {SPANS}, a AS (SELECT key, s // {7 * DAY} AS week, id % 3 AS pass, id AS line, CASE WHEN id % 3 = 0 THEN [5, 40, 58, 103, 105][id % 5 + 1] ELSE id * 37 % 110 END AS sec FROM spans),
  b AS (SELECT key, week, pass, line, sec * 1000000 AS s, (sec + CASE WHEN sec = 58 THEN 46 ELSE 2 END) * 1000000 AS e, line % 400 * 70000.0 AS told FROM a),
  t AS (SELECT *, {_UNDONE.format(t='s')} AS bs, {_UNDONE.format(t='e')} AS be FROM b),
  f AS (SELECT *, (s >= 60000000 AND NOT coalesce(s >= 100000000 AND bs <= 111000000, false)) OR (e >= 60000000 AND NOT coalesce(e >= 100000000 AND be <= 111000000, false)) AS amiss, s BETWEEN 60000000 AND 99999999 OR e BETWEEN 60000000 AND 99999999 AS between_,
    s < 60000000 AND e >= 100000000 AS across, told * told < greatest(be - s, 300000) * CAST(e - s AS DOUBLE) AS nearer FROM t),
  g AS (SELECT *, count(*) FILTER (s >= 60000000 OR e >= 60000000) OVER p > 0 AND count(*) FILTER (amiss) OVER p = 0 AS written, count(*) FILTER (across) OVER p AS n, count(*) FILTER (across AND coalesce(nearer, false)) OVER p AS agree,
    count(*) FILTER (between_) OVER (PARTITION BY key, week) - count(*) FILTER (between_) OVER p > 0 AS peers, max(e) OVER p > 111000000 AS past FROM f WINDOW p AS (PARTITION BY key, week, pass)),
  h AS (SELECT *, written AND (past OR CASE WHEN n > 0 THEN n = agree ELSE peers END) AS back FROM g),
  r AS (SELECT *, CASE WHEN back AND s >= 100000000 THEN bs ELSE s END AS s2, CASE WHEN back AND e >= 100000000 THEN be ELSE e END AS e2 FROM h)
  SELECT key, week, pass, line, s2 AS s, greatest(s2, e2) AS e, back FROM r""",
}
