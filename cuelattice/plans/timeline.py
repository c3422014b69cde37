"""Queries on intervals and runs, over events as timed words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import runs as rn
from .adapters import HOUR, MINUTE, SPANS, spans

K = ["key"]


def _purchases(d):
    return d.where("label in ('purchase', 'view')")


def island_merge(spark, sf_dir):
    return iv.merge_islands(spans(spark, sf_dir), K, HOUR)


_ISLANDS = """
  {name}_r AS (SELECT *, max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
  {name}_i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s - reach > {join} THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM {name}_r),
  {name} AS (SELECT key, island, min(s) AS s, max(e) AS e, count(*) AS n, CAST(sum(e - s) AS BIGINT) AS total FROM {name}_i GROUP BY key, island)"""


def _islands(name: str, source: str, join: int = 0) -> str:
    return _ISLANDS.format(name=name, source=source, join=join)


#: Pieces of the merged spans outside and inside the merged, widened cover.
_SWEEP = f"""
  cov AS (SELECT key, s - {HOUR // 2} AS s, e + {HOUR // 2} AS e FROM spans WHERE label IN ('purchase', 'view')),
  {_islands('ms', 'spans')}, {_islands('mc', 'cov')},
  holes AS (SELECT key, e AS s, coalesce(lead(s) OVER (PARTITION BY key ORDER BY s), 1152921504606846976) AS e FROM mc
    UNION ALL SELECT key, -1152921504606846976, min(s) FROM mc GROUP BY key
    UNION ALL SELECT DISTINCT key, -1152921504606846976, 1152921504606846976 FROM spans WHERE key NOT IN (SELECT key FROM mc)),
  outside AS (SELECT m.key, greatest(m.s, h.s) AS s, least(m.e, h.e) AS e FROM ms m JOIN holes h ON m.key = h.key AND m.s < h.e AND h.s < m.e),
  inside AS (SELECT m.key, greatest(m.s, c.s) AS s, least(m.e, c.e) AS e FROM ms m JOIN mc c ON m.key = c.key AND m.s < c.e AND c.s < m.e)"""


def coverage_gaps(spark, sf_dir):
    d = spans(spark, sf_dir)
    return iv.coverage_gaps(d, _purchases(d), K, HOUR // 2, HOUR, 2 * HOUR)


_GAPS = f"{_islands('g', 'outside', HOUR)}, gaps AS (SELECT key, s, e, total AS speech_us, n AS pieces FROM g WHERE total >= {2 * HOUR})"


def gap_words(spark, sf_dir):
    d = spans(spark, sf_dir)
    return iv.words_inside(coverage_gaps(spark, sf_dir), d, K, 6 * HOUR)


def interval_intersect(spark, sf_dir):
    d = spans(spark, sf_dir)
    got = iv.intersect(d, iv.widened(_purchases(d), HOUR // 2), K)
    return got.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("e") - F.col("s")).alias("us"))


def interval_except(spark, sf_dir):
    d = spans(spark, sf_dir)
    got = iv.subtract(d, iv.widened(_purchases(d), HOUR // 2), K).where("e > s")
    return got.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("e") - F.col("s")).alias("us"))


def overlap_share(spark, sf_dir):
    """The label that overlaps each purchase longest; ties go to the first label."""
    d = spans(spark, sf_dir)
    mine = d.where("label = 'purchase'").select("key", "id", "s", "e")
    got = iv.overlap_join(mine, d.where("label <> 'purchase'").select("key", "label", "s", "e"), K, 6 * HOUR)
    shares = got.groupBy("key", "id", "b_label").agg(F.sum(iv.overlap_us()).alias("us"))
    return shares.groupBy("key", "id").agg(F.min_by("b_label", F.struct(-F.col("us"), F.col("b_label"))).alias("label"), F.max("us").alias("us"))


def nearest_both_sides(spark, sf_dir):
    d = spans(spark, sf_dir).withColumn("mark", F.when(F.col("label") == "purchase", F.col("label")))
    return iv.nearest_sides(d, K, "mark").select("id", "before_label", "before_us", "after_label", "after_us")


def word_not_shown(spark, sf_dir):
    d = spans(spark, sf_dir)
    return iv.not_shown(d.where("label <> 'purchase'"), d.where("label = 'purchase'"), K, HOUR).select("key", "id")


def unshown_stretches(spark, sf_dir):
    d = spans(spark, sf_dir)
    return rn.unshown_stretches(iv.not_shown(d.where("label <> 'purchase'"), d.where("label = 'purchase'"), K, HOUR), K, 24 * HOUR, 3)


_NOT_SHOWN = f"""
  hidden AS (SELECT * FROM spans w WHERE label <> 'purchase' AND NOT EXISTS
    (SELECT 1 FROM spans p WHERE p.label = 'purchase' AND p.key = w.key AND p.s - {HOUR} <= w.s AND p.e + {HOUR} >= w.s))"""


def nearest_gap_snap(spark, sf_dir):
    d = spans(spark, sf_dir)
    cuts = d.where("label = 'purchase'").select("key", F.col("s").alias("at"))
    return iv.snap_to_gap(cuts, d.where("label <> 'purchase'"), K, MINUTE, 6 * HOUR).withColumnRenamed("at", "cut_at")


def breath_runs(spark, sf_dir):
    d = rn.breath_runs(spans(spark, sf_dir), K, 48 * HOUR, 3)
    return d.groupBy("key", "run", "label").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("words"))


def speaker_lines(spark, sf_dir):
    return rn.speaker_lines(spans(spark, sf_dir), K, 24 * HOUR)


def piles(spark, sf_dir):
    return rn.piles(spans(spark, sf_dir), K, 3 * HOUR, 3, F.col("e") - F.col("s") < 5 * MINUTE)


def turn_runs(spark, sf_dir):
    d = rn.turn_runs(spans(spark, sf_dir), K)
    return d.groupBy("key", "turn").agg(F.min("id").alias("first_id"), F.count("*").alias("words"), F.first("label").alias("label"))


def block_split(spark, sf_dir):
    d = rn.blocks(spans(spark, sf_dir), K, 24 * HOUR, F.col("label") == "error")
    return d.groupBy("key", "block").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("words"))


def level_runs(spark, sf_dir):
    d = spans(spark, sf_dir).withColumn("margin", F.col("id") % 7)
    return rn.level_runs(d, K, 6 * HOUR, "margin").select("id", "level")


def change_points(spark, sf_dir):
    return rn.change_points(spans(spark, sf_dir), K, 5, 3).where("strength is not null").select("key", "id", "strength")


def held_in_place(spark, sf_dir):
    d = spans(spark, sf_dir).withColumn("kept", F.col("label") == "view")
    return rn.held_in_place(d, K, "kept", 24 * HOUR).where("held").select("key", "id")


def time_share(spark, sf_dir):
    return rn.spread_evenly(spans(spark, sf_dir).withColumn("weight", F.length("label")), K, "weight").select("id", "at", "until")


def range_frame_fail(spark, sf_dir):
    d = spans(spark, sf_dir).withColumn("lost", F.col("label") == "error")
    got = iv.range_share(d, K, 15 * HOUR, "lost")
    return got.select("id", "near", "near_true", (2 * F.col("near_true") > F.col("near")).alias("failing"))


def vouched(spark, sf_dir):
    d = spans(spark, sf_dir).withColumn("good", F.when(F.col("label") == "view", True).when(F.col("label") == "error", False))
    return iv.vouched(d, K, "good").select("id", "vouched")


def sliding_windows(spark, sf_dir):
    d = iv.merge_islands(spans(spark, sf_dir), K, HOUR)
    return iv.sliding_windows(d, 2 * HOUR, HOUR, HOUR).select("key", "s", "window", "w_s", "w_e")


_W = "PARTITION BY key ORDER BY s, e, id"


def _numbered(name: str, source: str, starts: str, run: str = "run") -> str:
    """SQL for number_runs()."""
    return f"""{name}_f AS (SELECT *, CASE WHEN row_number() OVER ({_W}) = 1 OR coalesce({starts}, false) THEN 1 ELSE 0 END AS fresh FROM {source}),
  {name} AS (SELECT * EXCLUDE (fresh), sum(fresh) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS {run} FROM {name}_f)"""


_PAUSE = f"s - lag(e) OVER ({_W})"
_CHANGED = f"label IS DISTINCT FROM lag(label) OVER ({_W})"

QUERIES = {f.__name__: f for f in (island_merge, coverage_gaps, gap_words, interval_intersect, interval_except, overlap_share, nearest_both_sides, word_not_shown, unshown_stretches, nearest_gap_snap, breath_runs, speaker_lines, piles, turn_runs, block_split, level_runs, change_points, held_in_place, time_share, range_frame_fail, vouched, sliding_windows)}

SQL = {
    "island_merge": f"WITH {SPANS}, {_islands('m', 'spans', HOUR)} SELECT key, s, e, n FROM m",
    "coverage_gaps": f"WITH {SPANS}, {_SWEEP}, {_GAPS} SELECT * FROM gaps",
    "gap_words": f"""WITH {SPANS}, {_SWEEP}, {_GAPS}
  SELECT g.*, (SELECT count(*) FROM spans w WHERE w.key = g.key AND (w.s + w.e) // 2 BETWEEN g.s AND g.e) AS words FROM gaps g""",
    "interval_intersect": f"WITH {SPANS}, {_SWEEP}, {_islands('x', 'inside')} SELECT key, count(*) AS n, CAST(sum(e - s) AS BIGINT) AS us FROM x GROUP BY key",
    "interval_except": f"WITH {SPANS}, {_SWEEP}, {_islands('x', '(SELECT * FROM outside WHERE e > s)')} SELECT key, count(*) AS n, CAST(sum(e - s) AS BIGINT) AS us FROM x GROUP BY key",
    "overlap_share": f"""WITH {SPANS}, o AS (SELECT a.key, a.id, b.label, CAST(sum(least(a.e, b.e) - greatest(a.s, b.s)) AS BIGINT) AS us
    FROM spans a JOIN spans b ON a.key = b.key AND a.label = 'purchase' AND b.label <> 'purchase' AND a.s < b.e AND b.s < a.e GROUP BY ALL)
  SELECT key, id, label, us FROM (SELECT *, row_number() OVER (PARTITION BY key, id ORDER BY us DESC, label) AS k FROM o) WHERE k = 1""",
    "nearest_both_sides": f"""WITH {SPANS}, m AS (SELECT *, CASE WHEN label = 'purchase' THEN label END AS mark FROM spans),
  w AS (SELECT id, s, e, last_value(CASE WHEN mark IS NOT NULL THEN {{'l': mark, 'e': e}} END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
    first_value(CASE WHEN mark IS NOT NULL THEN {{'l': mark, 's': s}} END IGNORE NULLS) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM m)
  SELECT id, b.l AS before_label, CASE WHEN b IS NULL THEN 0 ELSE greatest(s - b.e, 0) END AS before_us, a.l AS after_label, CASE WHEN a IS NULL THEN 0 ELSE greatest(a.s - e, 0) END AS after_us FROM w""",
    "word_not_shown": f"WITH {SPANS}, {_NOT_SHOWN} SELECT key, id FROM hidden",
    "unshown_stretches": f"WITH {SPANS}, {_NOT_SHOWN}, {_numbered('n', 'hidden', f'{_PAUSE} >= {24 * HOUR}', 'stretch')} SELECT key, CAST(stretch AS BIGINT) AS stretch, min(s) AS s, max(e) AS e, count(*) AS words FROM n GROUP BY key, stretch HAVING count(*) >= 3",
    "nearest_gap_snap": f"""WITH {SPANS}, w AS (SELECT key, CAST(row_number() OVER ({_W}) - 1 AS BIGINT) AS gap, e AS s, lead(s) OVER ({_W}) AS e FROM spans WHERE label <> 'purchase'),
  g AS (SELECT key, gap, least(s, e) AS lo, greatest(s, e) AS hi FROM w WHERE e IS NOT NULL),
  c AS (SELECT DISTINCT key, s AS cut_at FROM spans WHERE label = 'purchase'),
  p AS (SELECT c.key, cut_at, gap, cut_at BETWEEN lo - {MINUTE} AND hi + {MINUTE} AS inside, abs(2 * cut_at - lo - hi) AS d FROM c JOIN g ON c.key = g.key
    WHERE cut_at BETWEEN lo - {MINUTE} AND hi + {MINUTE} OR (abs(2 * cut_at - lo - hi) <= {12 * HOUR})),
  r AS (SELECT *, row_number() OVER (PARTITION BY key, cut_at ORDER BY NOT inside, CASE WHEN inside THEN 0 ELSE d END, gap DESC) AS k FROM p)
  SELECT c.key, c.cut_at, r.gap FROM c LEFT JOIN r ON r.key = c.key AND r.cut_at = c.cut_at AND r.k = 1""",
    "breath_runs": f"""WITH {SPANS}, {_numbered('n', 'spans', f'{_PAUSE} > {48 * HOUR} OR {_CHANGED}', 'island')},
  p AS (SELECT *, (row_number() OVER (PARTITION BY key, island ORDER BY s, e, id) - 1) // 3 AS part FROM n),
  r AS (SELECT *, dense_rank() OVER (PARTITION BY key ORDER BY island, part) AS run FROM p)
  SELECT key, run, label, min(s) AS s, max(e) AS e, count(*) AS words FROM r GROUP BY ALL""",
    "speaker_lines": f"WITH {SPANS}, {_numbered('n', 'spans', f'{_PAUSE} > {24 * HOUR} OR {_CHANGED}', 'line')} SELECT key, CAST(line AS BIGINT) AS line, min(label) AS label, min(s) AS s, max(e) AS e, count(*) AS words FROM n GROUP BY key, line",
    "piles": f"""WITH {SPANS}, {_numbered('n', 'spans', f'NOT (e - lag(e) OVER ({_W}) < {3 * HOUR})', 'r0')},
  c AS (SELECT *, count(*) OVER (PARTITION BY key, r0) >= 3 AS core FROM n), i AS (SELECT *, core OR e - s < {5 * MINUTE} AS inn FROM c),
  {_numbered('q', 'i', f'inn AND NOT coalesce(lag(inn) OVER ({_W}), false)', 'pile')}
  SELECT key, CAST(pile AS BIGINT) AS pile, min(s) AS s, max(e) AS e, count(*) AS words, count(*) FILTER (core) AS core FROM q WHERE inn GROUP BY key, pile HAVING count(*) FILTER (core) > 0""",
    "turn_runs": f"""WITH {SPANS}, f AS (SELECT *, CASE WHEN lag(id) OVER v IS NULL OR label IS DISTINCT FROM lag(label) OVER v OR s < lag(s) OVER v THEN 1 ELSE 0 END AS fresh FROM spans WINDOW v AS (PARTITION BY key ORDER BY id)),
  t AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY id ROWS UNBOUNDED PRECEDING) AS turn FROM f)
  SELECT key, CAST(turn AS BIGINT) AS turn, min(id) AS first_id, count(*) AS words, min(label) AS label FROM t GROUP BY key, turn""",
    "block_split": f"WITH {SPANS}, {_numbered('n', 'spans', f'''lag(label = 'error') OVER ({_W}) OR {_PAUSE} >= {24 * HOUR} OR {_CHANGED}''', 'block')} SELECT key, CAST(block AS BIGINT) AS block, min(s) AS s, max(e) AS e, count(*) AS words FROM n GROUP BY key, block",
    "level_runs": f"WITH {SPANS}, {_numbered('n', 'spans', f'{_PAUSE} > {6 * HOUR}', 'r0')} SELECT id, max(id % 7) OVER (PARTITION BY key, r0) AS level FROM n",
    "change_points": f"""WITH {SPANS}, p AS (SELECT *, lag(label) OVER ({_W}) AS was, row_number() OVER ({_W}) AS k, count(*) OVER (PARTITION BY key) AS n FROM spans),
  c AS (SELECT p.*, count(*) FILTER (o.k < p.k) AS nb, count(*) FILTER (o.k >= p.k) AS na, count(*) FILTER (o.k < p.k AND o.label = p.was) AS sb, count(*) FILTER (o.k >= p.k AND o.label = p.label) AS sa
    FROM p JOIN p o ON o.key = p.key AND o.k BETWEEN p.k - 5 AND p.k + 4 GROUP BY ALL)
  SELECT key, id, sb + sa AS strength FROM c WHERE label <> was AND nb >= 3 AND na >= 3 AND 2 * sb > nb AND 2 * sa > na""",
    "held_in_place": f"""WITH {SPANS}, h AS (SELECT *, last_value(CASE WHEN label = 'view' THEN e END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
    first_value(CASE WHEN label = 'view' THEN s END IGNORE NULLS) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM spans)
  SELECT key, id FROM h WHERE label <> 'view' AND a - b <= {24 * HOUR}""",
    "time_share": f"""WITH {SPANS}, t AS (SELECT *, sum(len(label)) OVER (PARTITION BY key) AS total, sum(len(label)) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS upto,
    min(s) OVER (PARTITION BY key) AS low, max(e) OVER (PARTITION BY key) AS high FROM spans)
  SELECT id, CAST(low + floor((high - low) * CAST(upto - len(label) AS BIGINT) / CAST(total AS BIGINT)) AS BIGINT) AS at, CAST(low + floor((high - low) * CAST(upto AS BIGINT) / CAST(total AS BIGINT)) AS BIGINT) AS until FROM t""",
    "range_frame_fail": f"""WITH {SPANS} SELECT id, count(*) OVER w AS near, count(*) FILTER (label = 'error') OVER w AS near_true, 2 * count(*) FILTER (label = 'error') OVER w > count(*) OVER w AS failing
  FROM spans WINDOW w AS (PARTITION BY key ORDER BY s RANGE BETWEEN {15 * HOUR} PRECEDING AND {15 * HOUR} FOLLOWING)""",
    "vouched": f"""WITH {SPANS}, g AS (SELECT *, CASE WHEN label = 'view' THEN true WHEN label = 'error' THEN false END AS good FROM spans)
  SELECT id, coalesce(last_value(good IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)
    AND coalesce(first_value(good IGNORE NULLS) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), true) AS vouched FROM g""",
    "sliding_windows": f"""WITH {SPANS}, {_islands('m', 'spans', HOUR)}, k AS (SELECT key, s, e, greatest((e - s - {2 * HOUR}) // {HOUR} + 1, 1) AS n FROM m WHERE e - s >= {HOUR}),
  x AS (SELECT key, s, e, CAST(unnest(range(CAST(n AS BIGINT))) AS BIGINT) AS win FROM k)
  SELECT key, s, win AS "window", s + win * {HOUR} AS w_s, least(s + win * {HOUR} + {2 * HOUR}, e) AS w_e FROM x""",
}
