"""Who speaks: ranks, links between the labels of passes, shares."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def talk_ranking(turns: DataFrame, keys: Sequence[str], speaker: str = "speaker", body: str = "text", order: str = "number") -> DataFrame:
    """keys, speaker, words, rank: by words, ties by the first turn; rank 0 talks most."""
    got = turns.groupBy(*keys, speaker).agg(F.sum(F.size(text.tokens(F.col(body)))).cast("long").alias("words"), F.min(order).alias("__first"))
    w = Window.partitionBy(*keys).orderBy(F.desc("words"), "__first", speaker)
    return got.withColumn("rank", (F.row_number().over(w) - 1).cast("long")).drop("__first")


def pass_links(pairs: DataFrame, keys: Sequence[str], least: int = 3, share: float = 0.6) -> DataFrame:
    """keys, theirs, mine, n: a label of another pass stands for one of this pass, where they meet often enough.

    pairs has a row (mine, theirs) for each word that both heard.
    """
    n = pairs.groupBy(*keys, "mine", "theirs").agg(F.count("*").alias("n"))
    n = n.withColumn("__all", F.sum("n").over(Window.partitionBy(*keys, "theirs")))
    got = n.where((F.col("n") >= least) & (F.col("n") >= share * F.col("__all")))
    best = Window.partitionBy(*keys, "theirs").orderBy(F.desc("n"), "mine")
    return got.withColumn("__k", F.row_number().over(best)).where("__k = 1").drop("__k", "__all")


def majority(rows: DataFrame, keys: Sequence[str], label: str, weight: str) -> DataFrame:
    """keys, label, weight: the label with most weight; of equals the least."""
    sums = rows.groupBy(*keys, label).agg(F.sum(weight).alias(weight))
    return sums.groupBy(*keys).agg(F.min_by(label, F.struct(-F.col(weight), F.col(label))).alias(label), F.max(weight).alias(weight))


def labels(rows: DataFrame, label: str) -> DataFrame:
    """rows with speaker (without its piece's tag), base and linked."""
    return rows.withColumns({"speaker": text.speaker(F.col(label)), "base": text.based(text.speaker(F.col(label))), "linked": ~text.unlinked(F.col(label))})


def best_pairs(count: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) pairs, one to one, whose counts sum up to the most that is possible.

    Rows come in one by one; each takes the column that is cheapest along a path of re-assigned rows, with
    prices of rows and columns that keep all others content.
    """
    n = max(count.shape)
    cost = np.zeros((n + 1, n + 1))
    cost[1 : count.shape[0] + 1, 1 : count.shape[1] + 1] = -count
    price_r, price_c, owner = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for row in range(1, n + 1):
        owner[0], at = row, 0
        slack, via, done = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while owner[at]:
            done[at] = True
            gap = cost[owner[at]] - price_r[owner[at]] - price_c
            closer = ~done & (gap < slack)
            slack[closer], via[closer] = gap[closer], at
            nxt = int(np.argmin(np.where(done, np.inf, slack)))
            step = slack[nxt]
            price_r[owner[done]] += step
            price_c[done] -= step
            slack[~done] -= step
            at = nxt
        while at:
            owner[at], at = owner[via[at]], via[at]
    return [(owner[c] - 1, c - 1) for c in range(1, n + 1) if owner[c] <= count.shape[0] and c <= count.shape[1] and count[owner[c] - 1, c - 1] > 0]


def confusion_best(rows: DataFrame, keys: Sequence[str], truth: str, heard: str) -> DataFrame:
    """keys, truth, heard, n: labels matched one to one so that as many rows as possible agree.

    The rows are counted first; what goes to Python is a clip's table of counts, which has a cell for each pair of labels.
    """
    n = rows.groupBy(*keys, truth, heard).agg(F.count("*").alias("n"))
    n = n.select(*keys, F.col(truth).cast("string").alias("truth"), F.col(heard).cast("string").alias("heard"), "n")

    def run(clip: pd.DataFrame) -> pd.DataFrame:
        table = clip.pivot_table(index="truth", columns="heard", values="n", aggfunc="sum", fill_value=0)
        got = [(table.index[i], table.columns[j], int(table.iat[i, j])) for i, j in best_pairs(table.to_numpy())]
        return pd.DataFrame({**{k: [clip[k].iloc[0]] * len(got) for k in keys}, "truth": [g[0] for g in got], "heard": [g[1] for g in got], "n": [g[2] for g in got]})

    return n.where("truth is not null and heard is not null").groupBy(*keys).applyInPandas(run, n.schema)


def named_greedily(counts: DataFrame, keys: Sequence[str], a: str, b: str, n: str) -> DataFrame:
    """keys, a, b, n: names given one to one, the largest n first, of equals the least names.

    A clip's pairs of names are few: one fold over them in order.
    """
    pair = F.struct((-F.col(n)).cast("double").alias("k"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
    ordered = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(pair)).alias("p"))
    start = F.array().cast("array<struct<k:double,a:string,b:string>>")
    taken = F.aggregate("p", start, lambda s, x: F.when(F.exists(s, lambda y: (y["a"] == x["a"]) | (y["b"] == x["b"])), s).otherwise(F.concat(s, F.array(x))))
    return ordered.select(*keys, F.explode(taken).alias("x")).select(*keys, F.col("x.a").alias(a), F.col("x.b").alias(b), (-F.col("x.k")).alias(n))
