"""From words to cues: blocks, splits, replies and timing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text
from .runs import blocks


def halved(start: np.ndarray, end: np.ndarray, size: np.ndarray, mark: np.ndarray, first: np.ndarray, most_us: int, chars: int) -> np.ndarray:
    """The part, from 1, of each word in its block; words are in order, first says where blocks start."""
    n = len(start)
    bounds = np.append(np.flatnonzero(first), n)
    before = np.concatenate(([0], np.cumsum(size)))
    part = np.ones(n, np.int64)
    pause = np.zeros(n)
    pause[:-1] = (start[1:] - end[:-1]) / 1e6
    lasting = np.maximum.reduceat(end, bounds[:-1]) - np.minimum.reduceat(start, bounds[:-1])
    long = (lasting > most_us) | (np.diff(before[bounds]) - 1 > chars)
    for b in np.flatnonzero(long & (np.diff(bounds) > 1)):
        todo, done = [(bounds[b], bounds[b + 1])], 0
        while todo:
            lo, hi = todo.pop()
            m = hi - lo
            if m > 1 and (end[lo:hi].max() - start[lo:hi].min() > most_us or before[hi] - before[lo] - 1 > chars):
                span = max(int(end[hi - 1] - start[lo]), 1)
                score = mark[lo : hi - 1] + 2 * pause[lo : hi - 1] - np.abs(end[lo : hi - 1] + start[lo + 1 : hi] - start[lo] - end[hi - 1]) / 2 / span
                cut = lo + 1 + int(np.argmax(np.floor(score * 1e9 + 0.5)))
                todo += [(cut, hi), (lo, cut)]
            else:
                done += 1
                part[lo:hi] = done
    return part


def split_long(words: DataFrame, keys: Sequence[str], block: str = "block", label: str = "label", most_us: int = 6_000_000, chars: int = 84) -> DataFrame:
    """keys, block, part, label, s, e, texts: blocks() halved at their best place until each is short enough, or one word.

    The best place has a sentence's or a clause's end before it, a long pause behind it and lies near the middle of its time.
    The windows that number blocks leave each clip sorted in one partition: a task reads on from there and holds the words of a batch and
    of the block that goes on behind it, with neither a sort nor a shuffle more.
    """
    mark = F.when(text.ends_sentence(F.col("text")), 2.0).when(text.ends_clause(F.col("text")), 1.0).otherwise(0.0)
    d = words.select(*keys, block, label, "s", "e", "id", "text", mark.alias("mark"), F.coalesce(F.length("text") + 1, F.lit(0)).alias("size"))
    kinds = dict(words.dtypes)
    ddl = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"`{block}` long, part long, `{label}` {kinds[label]}, s long, e long, texts array<string>"])
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def begins(some: pa.Table) -> np.ndarray:
        """Whether a row is the first one of its block."""
        first = np.arange(some.num_rows) == 0
        for c in (*keys, block):
            column = some.column(c).combine_chunks()
            a, b = column.slice(1), column.slice(0, max(some.num_rows - 1, 0))
            first[1:] |= pc.fill_null(pc.not_equal(a, b), True).to_numpy(zero_copy_only=False) & ~pc.and_(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
        return first

    def lines(some: pa.Table) -> pa.RecordBatch:
        first = begins(some)
        start, end, size, weight = (some.column(c).to_numpy() for c in ("s", "e", "size", "mark"))
        part = halved(start, end, size, weight, first, most_us, chars)
        first[1:] |= part[1:] != part[:-1]
        at = np.flatnonzero(first)
        texts = pa.ListArray.from_arrays(pa.array(np.append(at, len(first)), pa.int32()), some.column("text").combine_chunks())
        same = lambda c: some.column(c).combine_chunks().take(pa.array(at))
        found = [*map(same, keys), same(block), pa.array(part[at]), same(label), pa.array(np.minimum.reduceat(start, at)), pa.array(np.maximum.reduceat(end, at)), texts]
        return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(found, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            some = pa.Table.from_batches([batch])
            before = [held[-1].slice(held[-1].num_rows - 1)] if held else []
            fresh = np.flatnonzero(begins(pa.concat_tables([*before, some]))[len(before) :])
            if len(fresh):
                done = pa.concat_tables([*held, some.slice(0, fresh[-1])])
                if done.num_rows:
                    yield lines(done)
                held, some = [], some.slice(fresh[-1])
            held.append(some)
        if held:
            yield lines(pa.concat_tables(held))

    return d.sortWithinPartitions(*keys, "s", "e", "id").mapInArrow(run, ddl)


def said_over(words: DataFrame, keys: Sequence[str], label: str = "label", most: int = 4, inside_us: int = 1_000_000) -> DataFrame:
    """words with over: turns of at most so many words that start well inside what another speaker is still saying."""
    w = Window.partitionBy(*keys).orderBy("s", "e", "id")
    fresh = ~F.col(label).eqNullSafe(F.lag(label).over(w))
    d = words.withColumn("__turn", F.sum(F.when(fresh, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    t = Window.partitionBy(*keys, "__turn")
    d = d.withColumns({"__size": F.count("*").over(t), "__start": F.min("s").over(t), "__reach": F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    reach = F.min_by("__reach", F.struct("s", "e", "id")).over(t)
    return d.withColumn("over", F.coalesce((F.col("__size") <= most) & (F.col("__start") + inside_us <= reach), F.lit(False))).drop("__turn", "__size", "__start", "__reach")


def build_cues(words: DataFrame, keys: Sequence[str], pause_us: int = 2_500_000, label: str = "label", most_us: int = 6_000_000, chars: int = 84) -> DataFrame:
    """keys, number, label, text, start_ms, end_ms: cues of the words (id, s, e, text, label) of each clip."""
    d = blocks(words, keys, pause_us, text.ends_sentence(F.col("text")), label)
    got = split_long(d, keys, "block", label, most_us, chars).withColumn("text", text.joined_words(F.col("texts")))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("s", "block", "part"))
    return got.select(*keys, number.alias("number"), label, "text", F.floor(F.col("s") / 1000).alias("start_ms"), F.ceil(F.col("e") / 1000).alias("end_ms"))
