"""Repairs of heard lines, and faults put in on purpose to measure them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .intervals import overlap_join
from .voices import dot


def attach_punctuation(texts: DataFrame, pieces: DataFrame, keys: Sequence[str], width: int = 64) -> DataFrame:
    """keys, at, text, s, e: the words of a text with the times of the pieces that hold their letters.

    texts has keys and text, pieces (id, s, e, text) are timed parts of it without punctuation. Both are
    laid out by their letters; a word takes the start of its first and the end of its last letter's piece, one
    without letters the times of the piece around it, or none between pieces.
    """
    w = texts.withColumn("__w", text.words(F.col("text"))).select(*keys, F.posexplode("__w").alias("at", "word"))
    w = w.withColumn("__n", text.letters(F.col("word")).cast("long"))
    order = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    w = w.withColumn("e", F.sum("__n").over(order)).withColumn("s", F.col("e") - F.col("__n")).drop("__n")
    p = pieces.withColumn("__n", text.letters(F.col("text")).cast("long"))
    order = Window.partitionBy(*keys).orderBy("s", "id").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("__upto", F.sum("__n").over(order))
    p = p.select(*keys, (F.col("__upto") - F.col("__n")).alias("s"), F.col("__upto").alias("e"), F.col("s").alias("from"), F.col("e").alias("until"))
    got = overlap_join(w, p, keys, width).groupBy(*keys, "at").agg(F.min("b_from").alias("s"), F.max("b_until").alias("e"))
    return w.select(*keys, "at", F.col("word").alias("text")).join(got, [*keys, "at"], "left")


def hand_over_copies(lines: DataFrame, keys: Sequence[str], within_us: int = 8_000_000) -> DataFrame:
    """lines without those that say what a dropped line of the same speaker said just before; the dropped one stays instead.

    lines has id, s, e, label, text, dropped. In pairs of equal neighbours the first written keeps its place and
    takes the times of the copy.
    """
    said = F.array_join(text.tokens(F.col("text")), " ")
    w = Window.partitionBy(*keys, "label", "__said").orderBy("s", "id")
    d = lines.withColumn("__said", said)
    nxt = F.struct("s", "e", "dropped")
    d = d.withColumns({"__next": F.lead(nxt).over(w), "__before": F.lag(F.struct("e", "dropped")).over(w)})
    near = lambda a, b: F.coalesce(a <= b + within_us, F.lit(False))
    takes = F.col("dropped") & F.coalesce(~F.col("__next.dropped"), F.lit(False)) & near(F.col("__next.s"), F.col("e")) & (F.col("__said") != "")
    gives = ~F.col("dropped") & F.coalesce(F.col("__before.dropped"), F.lit(False)) & near(F.col("s"), F.col("__before.e")) & (F.col("__said") != "")
    d = d.withColumns({"s": F.when(takes, F.col("__next.s")).otherwise(F.col("s")), "e": F.when(takes, F.col("__next.e")).otherwise(F.col("e")), "__takes": takes, "__gives": gives})
    return d.where((~F.col("dropped") | F.col("__takes")) & ~F.col("__gives")).select(*lines.columns[: len(lines.columns)]).withColumn("dropped", F.lit(False))


def echoes(lines: DataFrame, words: DataFrame, keys: Sequence[str], near_us: int = 3_000_000, least: float = 0.75, share: float = 0.6) -> DataFrame:
    """lines (line, s, e, text) of one or two words that repeat words (s, e, token) heard near them.

    A word is repeated by an equal one, or, if it has three letters, by one that holds in one piece three quarters of
    the shorter of the two: some stretch of that many of its letters. Stretches of every length from the least are made
    for both, and met by equality; all in the JVM.
    """
    tokens = text.tokens(text.echo_fold(F.col("text")))
    short = lines.withColumn("__t", tokens).where(F.size("__t").between(1, 2))
    mine = short.select(*keys, "line", F.size("__t").alias("n"), (F.col("s") - near_us).alias("s"), (F.col("e") + near_us).alias("e"), F.posexplode("__t").alias("at", "mine"))
    near = overlap_join(mine, words.select(*keys, "s", "e", text.echo_fold(F.col("token")).alias("token")), keys, 16 * near_us, closed=True)
    alike = near.select(*keys, "line", "n", "at", "mine", F.col("b_token").alias("theirs")).distinct()
    longer, shorter = (F.when(F.length("mine") >= F.length("theirs"), F.col(x)).otherwise(F.col(y)) for x, y in (("mine", "theirs"), ("theirs", "mine")))
    size = F.ceil(least * F.length(shorter)).cast("int")
    pieces = F.transform(F.sequence(F.lit(1), F.length(shorter) - size + 1), lambda i: F.substr(shorter, i, size))
    repeated = (F.col("mine") == F.col("theirs")) | ((F.length(shorter) >= 3) & F.exists(pieces, lambda p: F.contains(longer, p)))
    hit = alike.where(repeated).groupBy(*keys, "line", "n").agg(F.countDistinct("at").alias("same"))
    return lines.join(hit.where(F.col("same") >= share * F.col("n")).select(*keys, "line"), [*keys, "line"], "left_semi")


def _chance(seed: int, *columns: str) -> Column:
    """A number below 1 that hangs on the seed and the columns only."""
    return F.conv(F.left(F.md5(F.concat_ws(":", F.lit(seed), *columns)), F.lit(8)), 16, 10).cast("double") / 2.0**32


def inject(words: DataFrame, keys: Sequence[str], kind: str, share: float, seed: int = 1) -> DataFrame:
    """words (id, s, e, label, text) with one kind of fault in so great a share of them, and fault saying where.

    Kinds: dropped, late (two seconds), relabelled, doubled, instant. The choice depends on seed and row only.
    """
    hit = _chance(seed, *keys, "id") < share
    d = words.withColumn("fault", hit)
    if kind == "dropped":
        return d.where(~hit)
    if kind == "late":
        return d.withColumns({c: F.when(hit, F.col(c) + 2_000_000).otherwise(F.col(c)) for c in ("s", "e")})
    if kind == "relabelled":
        return d.withColumn("label", F.when(hit, F.concat("label", F.lit("~x1"))).otherwise(F.col("label")))
    if kind == "instant":
        return d.withColumn("e", F.when(hit, F.col("s")).otherwise(F.col("e")))
    if kind == "doubled":
        again = F.explode(F.when(hit, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
        d = d.withColumn("__again", again)
        return d.withColumns({c: F.when(F.col("__again"), F.col(c) + 500_000).otherwise(F.col(c)) for c in ("s", "e")}).drop("__again")
    raise ValueError(kind)


def bench_cells(clips: DataFrame, faults: DataFrame, settings: DataFrame, seeds: int) -> DataFrame:
    """A row for each clip, fault, setting and seed of a bench; faultless clips need one seed."""
    every = clips.crossJoin(faults).crossJoin(settings)
    return every.withColumn("seed", F.explode(F.sequence(F.lit(0), F.when(F.col("fault") == "none", 0).otherwise(seeds - 1))))


def majority_owner(rows: DataFrame, keys: Sequence[str], owner: str) -> DataFrame:
    """keys, owner: the commonest owner, of equals the least."""
    n = rows.groupBy(*keys, owner).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.min_by(owner, F.struct(-F.col("n"), F.col(owner))).alias(owner))


def _mean_alike(total: Column, n: Column, other: Column, m: Column) -> Column:
    """Mean similarity between two groups of unit vectors by their sums."""
    return dot(total, other) / (n * m)


def seams(windows: DataFrame, keys: Sequence[str], join: float, side: int = 5, least: int = 3, most: int = 2) -> DataFrame:
    """keys, id: windows of one label (id, s, vec) before which the voice changes.

    The windows on both sides, up to side of them and least at least, must be more alike among themselves than
    across. Similarities are cosines, so sums of unit vectors over two frames say all three means. Of the places
    that hold, the clearest come first, and none within side windows of one before it.
    """
    w = Window.partitionBy(*keys).orderBy("s", "id")
    size = F.greatest(F.sqrt(dot("vec", "vec")), F.lit(1e-12))
    d = windows.withColumn("__size", size).withColumn("__u", F.transform("vec", lambda x: x / F.col("__size")))
    d = d.withColumns({"__at": F.row_number().over(w), "__b": F.collect_list("__u").over(w.rowsBetween(-side, -1)), "__a": F.collect_list("__u").over(w.rowsBetween(0, side - 1))})
    d = d.where((F.size("__b") >= least) & (F.size("__a") >= least))
    added = lambda c: F.aggregate(F.slice(c, F.lit(2), F.lit(side)), F.get(c, F.lit(0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    d = d.select(*keys, "id", "__at", F.size("__b").alias("__m"), F.size("__a").alias("__n"), added(F.col("__b")).alias("__sb"), added(F.col("__a")).alias("__sa"))
    cross = _mean_alike(F.col("__sb"), F.col("__m"), F.col("__sa"), F.col("__n"))
    inner = F.least(*[(dot(F.col(c), F.col(c)) - F.col(n)) / F.greatest(F.col(n) * (F.col(n) - 1), F.lit(1)) for c, n in (("__sb", "__m"), ("__sa", "__n"))])
    d = d.select(*keys, "id", "__at", cross.alias("__cross"), inner.alias("__inner")).where((F.col("__cross") < join) & (F.col("__inner") >= (join + F.col("__cross")) / 2))
    # a clip's places that hold are few: one fold over them, clearest first
    places = d.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("__cross").alias("cross"), F.col("__at").alias("at"), "id"))).alias("p"))
    start = F.slice("p", 1, 0)
    free = lambda kept, x: (F.size(kept) < most) & F.forall(kept, lambda k: F.abs(k["at"] - x["at"]) >= side)
    kept = F.aggregate("p", start, lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    return places.select(*keys, F.explode(kept).alias("x")).select(*keys, "x.id")
