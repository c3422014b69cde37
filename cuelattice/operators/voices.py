"""Voice prints: averages, nearest speakers, how well voices are told apart."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import nearest_sides


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def cosine(a: str | Column, b: str | Column) -> Column:
    """0 where a vector is zero."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def sums(prints: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n, total: the vector sum of each group, summed place by place so that no group is gathered."""
    each = prints.select(*keys, F.posexplode("vec").alias("i", "x")).groupBy(*keys, "i").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    got = each.groupBy(*keys).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    return got.select(*keys, "n", F.transform("v", lambda s: s["x"]).alias("total"))


#: Bytes of label averages that a task holds at once.
BOUND = 32 * 1024 * 1024
#: Prints that are compared with one block of averages at once, where the averages take several.
PRINTS = 65_536


def _two_best(vec: np.ndarray, centres: np.ndarray, labels: np.ndarray) -> tuple[list, ...]:
    """The two centres with the largest products with each vector, the first of those equal to nine places: their labels and products."""
    if not len(centres):
        return tuple([None] * len(vec) for _ in range(4))
    exact = vec @ centres.T
    dots, rows = np.round(exact, 9), np.arange(len(vec))
    first = dots.argmax(1)
    top = exact[rows, first]
    dots[rows, first] = -np.inf
    second = dots.argmax(1)
    has, two = dots[rows, second] > -np.inf, exact[rows, second]
    return labels[first].tolist(), top.tolist(), [v if h else None for v, h in zip(labels[second].tolist(), has, strict=True)], [float(v) if h else None for v, h in zip(two, has, strict=True)]


def two_nearest(prints: DataFrame, label: str, unit: bool) -> DataFrame:
    """id, label1, near1, label2, near2: the two labels whose averages are most alike to each print (id, vec).

    unit compares by cosine with the sums; else the product with the mean of the group is taken. The averages go to
    every task if their counted size allows; else prints and averages meet in blocks, and the best of all blocks
    are chosen by an aggregation.
    """
    s = sums(prints.where(F.col(label).isNotNull()), [label])
    centre = F.transform("total", lambda x: x / F.when(F.lit(unit), F.sqrt(dot("total", "total"))).otherwise(F.col("n")))
    s = s.select(F.col(label).alias("l"), F.transform(centre, lambda x: F.coalesce(x, F.lit(0.0))).alias("c"))
    n, dim = s.agg(F.count("*"), F.coalesce(F.max(F.size("c")), F.lit(0))).first()
    kind = dict(prints.dtypes)[label]
    ddl = f"id {dict(prints.dtypes)['id']}, label1 {kind}, near1 double, label2 {kind}, near2 double"
    # the label comes along for its type
    d = prints.select("id", F.col("vec").cast("array<double>").alias("vec"), F.col(label).alias("l"))

    def compared(batch: pa.Table | pa.RecordBatch, labels: np.ndarray, centres: np.ndarray) -> pa.RecordBatch:
        vec = batch.column("vec")
        vec = (vec.combine_chunks() if isinstance(vec, pa.ChunkedArray) else vec).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        if unit:
            vec = vec / np.maximum(np.sqrt((vec * vec).sum(1)), 1e-300)[:, None]
        got, kind_ = _two_best(vec, centres, labels), batch.schema.field("l").type
        ids = batch.column("id")
        return pa.record_batch([ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, *(pa.array(g, t) for g, t in zip(got, (kind_, pa.float64(), kind_, pa.float64()), strict=True))], names=["id", "label1", "near1", "label2", "near2"])

    if n * dim * 8 <= BOUND:
        rows = sorted((tuple(r) for r in s.collect()), key=lambda r: r[0])
        sent = prints.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], object), np.array([r[1] for r in rows], float).reshape(n, dim)))

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    yield compared(batch, *sent.value)

        return d.mapInArrow(run, ddl)
    blocks, parts = -(-n * dim * 8 // BOUND), max(1, -(-d.count() // PRINTS))
    left = d.withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "part": F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")})
    right = s.withColumns({"block": F.pmod(F.xxhash64("l"), F.lit(blocks)).cast("int"), "part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})

    def both(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        rows = sorted(zip(theirs.column("l").to_pylist(), theirs.column("c").to_pylist(), strict=True), key=lambda r: r[0])
        if not mine.num_rows or not rows:
            return pa.table({c: pa.array([], t) for c, t in zip(("id", "label1", "near1", "label2", "near2"), (mine.schema.field("id").type, theirs.schema.field("l").type, pa.float64(), theirs.schema.field("l").type, pa.float64()), strict=True)})
        return pa.Table.from_batches([compared(mine, np.array([r[0] for r in rows], object), np.array([r[1] for r in rows], float))])

    met = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(both, ddl)
    each = met.select("id", F.explode(F.array(F.struct((-F.round("near1", 9)).alias("k"), F.col("label1").alias("l"), F.col("near1").alias("near")), F.struct((-F.round("near2", 9)).alias("k"), F.col("label2").alias("l"), F.col("near2").alias("near")))).alias("x")).where("x.k is not null")
    best = each.groupBy("id").agg(F.min("x").alias("one"), F.slice(F.sort_array(F.collect_list("x")), 2, 1).alias("more"))
    return best.select("id", F.col("one.l").alias("label1"), F.col("one.near").alias("near1"), F.get("more", F.lit(0))["l"].alias("label2"), F.get("more", F.lit(0))["near"].alias("near2"))


def nearest(prints: DataFrame, label: str = "label") -> DataFrame:
    """prints (id, vec) with near, similarity: the label whose average is nearest; of equals the least."""
    two = two_nearest(prints, label, unit=True)
    return prints.join(two.select("id", F.col("label1").alias("near"), F.round("near1", 9).alias("similarity")), "id")


def _own(prints: DataFrame, label: str) -> DataFrame:
    """prints with n and total of their own label's vectors."""
    return prints.where(F.col(label).isNotNull()).join(sums(prints.where(F.col(label).isNotNull()), [label]), label)


def leave_one_out(prints: DataFrame, label: str = "label") -> DataFrame:
    """prints (id, vec) with own, rival: similarity to the rest of its own label, and the best to another label's average."""
    d = _own(prints, label).join(two_nearest(prints, label, unit=True), "id")
    rest = F.zip_with("total", "vec", lambda x, y: x - y)
    rival = F.when(F.col("label1") == F.col(label), F.col("near2")).otherwise(F.col("near1"))
    return d.select(*prints.columns, F.when(F.col("n") > 1, cosine(rest, "vec")).alias("own"), rival.alias("rival"))


def apart(prints: DataFrame, label: str = "label") -> DataFrame:
    """label, n, apart: mean of own similarity less the best rival's."""
    d = leave_one_out(prints, label).where("own is not null and rival is not null")
    return d.groupBy(label).agg(F.count("*").alias("n"), F.avg(F.col("own") - F.col("rival")).alias("apart"))


def silhouette(prints: DataFrame, label: str = "label") -> DataFrame:
    """prints (id, vec) with silhouette by cosine distance, without comparing prints in pairs.

    The mean distance of a unit vector to a group is 1 less its product with the group's mean unit vector.
    """
    size = F.sqrt(dot("vec", "vec"))
    unit = prints.withColumn("__size", size).withColumn("vec", F.transform("vec", lambda x: x / F.col("__size"))).drop("__size")
    d = _own(unit, label).join(two_nearest(unit, label, unit=False), "id")
    a = 1 - (dot("vec", "total") - 1) / (F.col("n") - 1)
    b = 1 - F.when(F.col("label1") == F.col(label), F.col("near2")).otherwise(F.col("near1"))
    return d.select(*[c for c in prints.columns if c != "vec"], F.when(F.col("n") > 1, (b - a) / F.greatest(a, b)).alias("silhouette"))


def moved(prints: DataFrame, label: str = "label", least: float = 0.4, more: float = 0.15) -> DataFrame:
    """prints with settled: another label where it is near enough and nearer by a margin than its own without it."""
    n = nearest(prints, label)
    l1 = leave_one_out(prints, label).select("id", "own")
    go = (F.col("near") != F.col(label)) & (F.col("similarity") >= least) & (F.col("similarity") - F.coalesce("own", F.lit(-1.0)) >= more)
    return n.join(l1, "id", "left").withColumn("settled", F.when(go, F.col("near")).otherwise(F.col(label))).drop("own")


def short_follow(lines: DataFrame, keys: Sequence[str], short_us: int, label: str = "label", moved_to: str = "settled") -> DataFrame:
    """lines with followed: a short line goes where the long lines of its label before and after it both went."""
    w = Window.partitionBy(*keys, label).orderBy("s", "e", "id")
    went = F.when(F.col("e") - F.col("s") >= short_us, F.col(moved_to))
    before = F.last(went, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(went, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    short = (F.col("e") - F.col("s") < short_us) & (before == after) & (before != F.col(label))
    return lines.withColumn("followed", F.when(F.coalesce(short, F.lit(False)), before).otherwise(F.col(moved_to)))


def off_voice(words: DataFrame, keys: Sequence[str], mark: str, far_us: int) -> DataFrame:
    """Words without a mark whose nearest marked words on both sides are missing or further off than far_us."""
    d = nearest_sides(words, keys, mark).where(F.col(mark).isNull())
    far = lambda side: F.col(f"{side}_label").isNull() | (F.col(f"{side}_us") > far_us)
    return d.where(far("before") & far("after"))
