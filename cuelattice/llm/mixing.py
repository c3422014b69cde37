"""Mixing sources to target weights.

Each document gets a hash-random key. Within its source the documents stand in key order, a distributed
prefix sum of their sizes gives each one's place, and the source is cut at its exact budget; a budget
above the source's size repeats whole epochs first.

The keys are uniform, so ranges of keys are ranges of about equal numbers of documents: the prefix sum
runs over coarse ranges, over the fine ranges of one coarse range and over the documents of one fine
range, and no window ever holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, fresh, small

#: Coarse ranges of a source; documents that a fine range holds on average.
COARSE, FINE_ROWS = 256, 64


def _water_level(sources: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """source, source_size, target: shares by weight, none above cap times its source's size.

    Sources in the order of cap / weight fill up one after another; the first that stays below its cap
    sets the level for all that follow. The table has one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("weight", F.element_at(cycle, (((F.row_number().over(by_name) - 1) % len(weights)) + 1).cast("int")))
    s = s.withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(everything))
    s = s.withColumn("spent", F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("total") - F.coalesce("spent", F.lit(0.0))) / F.col("left"))
    # at the first source that stays below its limit, all before it are full
    s = s.withColumn("place", F.row_number().over(order))
    first = F.min(F.when(F.col("limit") > F.col("level") * F.col("weight"), F.struct("place", "level"))).over(everything)
    s = s.withColumn("share", first["level"] * F.col("weight"))
    return s.select("source", "source_size", F.when(F.col("share") < F.col("limit"), F.col("share")).otherwise(F.col("limit")).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with size, source_size, target, epochs and taken.

    size is the text's number of white-space-delimited words (null or empty: 0). Sources by code point,
    null last, get the weights in turn and share the total size; a target stops at cap times its
    source's size. taken counts the words that the mix takes from the document, repeats included: its
    whole text epochs times, then the words that fall before the cut of its source. A source without
    words has target 0. Equal rows (same source, id and size) stand at one place and share what the cut
    leaves there, rounded down. A null id is ordered like an empty one. Reruns agree, as the keys depend
    on seed and id only. Columns of docs with the names of results are replaced, all others stay.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    docs = docs.drop("size", "source_size", "target", "epochs", "taken")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    keyed = docs.select(F.col(source_col).alias("source"), key.alias("key"), size.alias("size"))
    places = scratch.write(keyed.groupBy("source", "key", "size").agg(F.count("*").alias("copies")), "places")
    sources = places.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).cast("long").alias("source_size"), F.count("*").alias("rows"))
    sources = scratch.write(sources, "sources")
    n_sources = sources.count()
    targets = _water_level(sources.drop("rows"), weights, cap)
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")).cast("long")).otherwise(F.lit(0))
    plan = targets.withColumn("epochs", whole).withColumn("rest", F.when(F.col("source_size") > 0, budget - whole * F.col("source_size")).otherwise(F.lit(0)))
    plan = scratch.write(plan.join(sources.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "plan")

    # the place where each source is cut
    p = places.alias("p").join(small(plan.alias("q"), 128, n_sources), F.col("p.source").eqNullSafe(F.col("q.source"))).select("p.*", "q.rest", "q.rows")
    point = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    p = p.withColumn("coarse", F.floor(point * COARSE).cast("int"))
    fine = F.greatest(F.lit(1.0), F.ceil(F.col("rows") / (COARSE * FINE_ROWS)).cast("double"))
    p = p.withColumn("fine", F.floor((point * COARSE - F.col("coarse")) * fine).cast("long"))
    p = p.withColumn("words", F.col("size") * F.col("copies"))
    before = (Window.unboundedPreceding, -1)
    totals = scratch.write(p.groupBy("source", "coarse", "fine").agg(F.sum("words").alias("words"), F.first("rest").alias("rest")), "ranges")
    outer = totals.groupBy("source", "coarse").agg(F.sum("words").alias("words"))
    outer = outer.select("source", "coarse", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("coarse").rowsBetween(*before)), F.lit(0)).alias("base"))
    inner = totals.withColumn("inside", F.coalesce(F.sum("words").over(Window.partitionBy("source", "coarse").orderBy("fine").rowsBetween(*before)), F.lit(0)))
    at = inner.alias("i").join(outer.alias("o"), F.col("i.source").eqNullSafe(F.col("o.source")) & (F.col("i.coarse") == F.col("o.coarse")))
    start = F.col("o.base") + F.col("i.inside")
    # the one fine range of each source in which its budget ends
    ends = at.where((start <= F.col("i.rest")) & (F.col("i.rest") < start + F.col("i.words"))).select("i.source", "i.coarse", "i.fine", start.alias("start"), "i.rest")
    ends = scratch.write(ends, "ends")
    hit = p.alias("p").join(small(ends.alias("e"), 128, n_sources), F.col("p.source").eqNullSafe(F.col("e.source")) & (F.col("p.coarse") == F.col("e.coarse")) & (F.col("p.fine") == F.col("e.fine")))
    order = Window.partitionBy("source").orderBy("key", "size")
    hit = hit.select("p.source", "p.key", "p.size", "p.copies", "p.words", "e.rest", "e.start").withColumn("place", F.col("start") + F.coalesce(F.sum("words").over(order.rowsBetween(*before)), F.lit(0)))
    hit = hit.where((F.col("place") <= F.col("rest")) & (F.col("rest") < F.col("place") + F.col("words")))
    cuts = hit.select(F.col("source").alias("cut_source"), F.col("key").alias("cut_key"), F.col("size").alias("cut_size"), F.floor((F.col("rest") - F.col("place")) / F.col("copies")).cast("long").alias("partial"))
    results = ["size", "source_size", "target", "epochs"]
    own_key, of, cut_key, cut_size, partial = fresh([*docs.columns, *results, "taken"], "key", "cut_source", "cut_key", "cut_size", "partial")
    plan = plan.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left").select(F.col("source").alias(of), "source_size", "target", "epochs", F.col("cut_key").alias(cut_key), F.col("cut_size").alias(cut_size), F.col("partial").alias(partial))
    plan = scratch.write(plan, "cuts")

    out = docs.withColumns({"size": size, own_key: key}).join(small(plan, 192, n_sources), F.col(source_col).eqNullSafe(F.col(of)))
    mine, cut = F.struct(F.col(own_key).alias("key"), "size"), F.struct(F.col(cut_key).alias("key"), F.col(cut_size).alias("size"))
    extra = F.when(F.col(cut_key).isNull(), 0).when(mine < cut, F.col("size")).when(mine == cut, F.col(partial)).otherwise(0)
    taken = (F.col("epochs") * F.col("size") + extra).cast("long")
    return out.select(*docs.columns, *results, taken.alias("taken"))


#: The same in DuckDB, for rows with unique ids.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS lim FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))::DOUBLE
     / sum(weight) OVER (ORDER BY lim / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
n AS (SELECT *, row_number() OVER (ORDER BY lim / weight, encode(source) NULLS LAST) AS place FROM l),
v AS (SELECT min(place) AS place FROM n WHERE lim > level * weight),
t AS (SELECT source, source_size, CASE WHEN f.share * weight < lim THEN f.share * weight ELSE lim END AS target
      FROM n LEFT JOIN (SELECT n.level AS share FROM n JOIN v ON n.place = v.place) f ON true),
b AS (SELECT *, CAST(round(target) AS BIGINT) AS budget FROM t),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b),
r AS (SELECT *, CASE WHEN source_size > 0 THEN budget - epochs * source_size ELSE 0 END AS rest FROM e),
p AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.epochs, r.rest,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, rest - place)) AS BIGINT) AS taken
FROM p
"""
