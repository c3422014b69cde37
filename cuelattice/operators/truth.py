"""What was heard and shown against a truth: matched words, silence, turns, sentence edges."""

from __future__ import annotations

import functools
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .alignment import each_clip


def matched(a: Sequence[str], b: Sequence[str], at: np.ndarray, there: np.ndarray, cap: float = 60.0) -> list[tuple[int, int]]:
    """Places of equal words matched in order: as many as can be, and of such matchings the one closest in time.

    A chain of pairs is worth one whole number: a unit for each pair, less the microseconds (cap at most) that its words
    are apart; a unit is more than all of that together. For each beginning of b the best chain into it is kept by its
    last pair. Only pairs of equal words that make a chain better are stored, each with the pair before it.
    """
    furthest = int(cap * 1e6)
    unit = furthest * (min(len(a), len(b)) + 1)
    places: dict[str, list[int]] = {}
    for j, token in enumerate(b):
        if token:
            places.setdefault(token, []).append(j)
    where = {token: np.array(js) for token, js in places.items()}
    mine, theirs = (np.round(np.asarray(x, float) * 1e6).astype(np.int64) for x in (at, there))
    worth, last = np.zeros(len(b) + 1, np.int64), np.full(len(b) + 1, -1)
    pairs: list[tuple[int, int, int]] = []
    order = np.arange(len(b) + 1)
    for i, token in enumerate(a):
        if (js := where.get(token)) is None:
            continue
        value = worth[js] + unit - np.minimum(np.abs(mine[i] - theirs[js]), furthest)
        better = value > worth[js + 1]
        if not better.any():
            continue
        js, value = js[better], value[better]
        number = len(pairs) + np.arange(len(js))
        pairs.extend(zip([i] * len(js), js.tolist(), last[js].tolist(), strict=True))
        worth[js + 1], last[js + 1] = value, number
        best = np.maximum.accumulate(worth)
        last = last[np.maximum.accumulate(np.where(worth == best, order, 0))]
        worth = best
    out, k = [], int(last[-1])
    while k >= 0:
        i, j, k = pairs[k]
        out.append((i, j))
    return out[::-1]


def truth_pairs(truth: DataFrame, heard: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, id, heard_id: the words of the truth and of the hearing (id, token, s each) that are the same words.

    The best order of matches depends on all words of a clip: a task reads both sides of its clips, one clip after the other.
    """
    a, b = (d.select(*keys, F.lit(side).alias("__side"), "s", "id", "token") for side, d in enumerate((truth, heard)))

    def run(rows: list[tuple]) -> Iterator[tuple]:
        n = sum(side == 0 for side, *_ in rows)
        one, other = rows[:n], rows[n:]
        said, at = ([[r[k] for r in part] for part in (one, other)] for k in (3, 1))
        for i, j in matched(*said, *(np.array(x, float) / 1e6 for x in at)):
            yield one[i][2], other[j][2]

    return each_clip(a.unionByName(b), keys, ["__side", F.col("s").asc_nulls_last(), "id"], run, "id long, heard_id long")


def on_silence(words: DataFrame, speech: DataFrame, keys: Sequence[str], silent_us: int = 300_000) -> DataFrame:
    """Words (id, s, e) whose middle is further than silent_us from any speech: both in one order by time.

    The furthest end of the speech that started before the middle, and the next start behind it, say how far.
    """
    middle = F.floor((F.col("s") + F.col("e")) / 2)
    w = words.select(*keys, "id", middle.alias("at"), F.lit(None).cast("long").alias("reach"), F.lit(1).alias("kind"))
    s = speech.select(*keys, F.lit(None).cast("long").alias("id"), F.col("s").alias("at"), F.col("e").alias("reach"), F.lit(0).alias("kind"))
    order = Window.partitionBy(*keys).orderBy("at", "kind")
    before = F.max("reach").over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(F.col("kind") == 0, F.col("at"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    d = w.unionByName(s).withColumns({"__b": before, "__a": after}).where("kind = 1")
    far = (F.col("__b").isNull() | (F.col("at") - F.col("__b") > silent_us)) & (F.col("__a").isNull() | (F.col("__a") - F.col("at") > silent_us))
    return words.join(d.where(far).select(*keys, "id"), [*keys, "id"], "left_semi")


def flips(words: DataFrame, keys: Sequence[str], turn: str, label: str) -> DataFrame:
    """keys, flips: how often the label changes between the words (id) of one turn."""
    was = F.lag(label).over(Window.partitionBy(*keys, turn).orderBy("id"))
    return words.withColumn("__was", was).groupBy(*keys).agg(F.count_if(F.coalesce(F.col("__was") != F.col(label), F.lit(False))).alias("flips"))


def said_again(said: list[tuple], cues: Iterable[list[tuple]], used: set, near_us: int) -> Iterator[list]:
    """For each cue (id, token, s, e of each word) that has any, the words not used that were said (s, id, token) close by with a neighbour."""
    times: dict[object, list[int]] = {}
    before = None
    for s, _, token in sorted(said, key=lambda w: (w[0] is not None, w[0], w[1] is not None, w[1])):
        if s is not None and token is not None:
            times.setdefault(token, []).append(s)
            if before is not None:
                times.setdefault((before, token), []).append(s)
        before = token
    for cue in cues:
        cue.sort(key=lambda w: (w[0] is not None, w[0]))
        tokens = [None, *(w[1] for w in cue), None]
        found = []
        for (key, token, s, e), before, after in zip(cue, tokens, tokens[2:], strict=False):
            if key in used or key is None or token is None or s is None or e is None:
                continue
            ways = [way for way, other in (((before, token), before), ((token, after), after)) if other is not None]
            for at in filter(None, map(times.get, ways or [token])):
                first = bisect_left(at, s - near_us)
                if first < len(at) and at[first] <= e + near_us:
                    found.append(key)
                    break
        if found:
            yield found


def duplicated_in(lines: DataFrame, cues: DataFrame, used: DataFrame, keys: Sequence[str], near_us: int = 3_000_000) -> DataFrame:
    """keys, id: shown words that the match left over and that were said close by with a neighbour of theirs.

    Words come in lists, so that a line of them is one row wherever rows are shuffled or sorted: lines has ids, tokens and times, cues
    cue, s, e, ids and tokens, used the ids of shown words that are matched. The words of a cue may stand in more than one row.
    Neighbours are those of the cue by id, and of all that was said by time and id. A task reads its clips one after the other.
    """
    kinds = (lines.withColumn("__kind", F.lit(0)), cues.withColumn("__kind", F.lit(1)), used.withColumn("__kind", F.lit(2)))
    rows = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kinds).select(*keys, "__kind", "ids", "tokens", "times", "cue", "s", "e")
    rows = rows.where(functools.reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]))

    def run(clip: list[tuple]) -> Iterator[tuple]:
        said, shown, matches = [], {}, set()
        for kind, ids, tokens, times, cue, s, e in clip:
            if kind == 0:
                said += zip(times or (), ids or (), tokens or (), strict=True)
            elif kind == 1:
                shown.setdefault(cue, []).extend((key, token, s, e) for key, token in zip(ids or (), tokens or (), strict=True))
            else:
                matches.update(ids or ())
        return ((found,) for found in said_again(said, shown.values(), matches, near_us))

    ids = dict(cues.dtypes)["ids"]
    return each_clip(rows, keys, [], run, f"ids {ids}").select(*keys, F.explode("ids").alias("id"))


def duplicated(words: DataFrame, shown: DataFrame, used: DataFrame, keys: Sequence[str], near_us: int = 3_000_000) -> DataFrame:
    """Shown words (cue, id, token, s, e of their cue) that the match left over and that were said close by with a neighbour of theirs.

    words has id, token, s; used has the ids of shown words that are matched. A cue of one word counts if that word was
    said close by. Where the words of a line are at hand as lists, duplicated_in() shuffles fewer rows.
    """
    listed = lambda d, *cs, **lists: d.select(*keys, *cs, *[F.array(c).alias(name) for name, c in lists.items()])
    hit = duplicated_in(listed(words, ids="id", tokens="token", times="s"), listed(shown, "cue", "s", "e", ids="id", tokens="token"), listed(used, ids="id"), keys, near_us)
    # the planner does not see how many words a list holds
    return shown.join(hit.hint("merge"), [*keys, "id"], "left_semi")


def sentence_edges(sentences: DataFrame, words: DataFrame, keys: Sequence[str], out_us: int = 500_000) -> DataFrame:
    """keys, line, held, outside, first, last: how the heard words of a sentence lie to its times.

    words has a row (line, seq, s, e) for each word said in a sentence; s and e are null where it was not heard. first and last
    are the distances in microseconds of the sentence's first and last word from its edges, where they were heard;
    outside counts heard words whose middle is further than out_us outside the sentence.
    """
    heard = F.col("h.s").isNotNull()
    both = words.alias("h").join(sentences.alias("t"), [*keys, "line"])
    middle = (F.col("h.s") + F.col("h.e")) / 2
    far = (middle < F.col("t.s") - out_us) | (middle > F.col("t.e") + out_us)
    got = both.groupBy(*keys, "line").agg(
        F.count_if(heard).alias("held"),
        F.count_if(heard & far).alias("outside"),
        F.min_by(F.col("h.s") - F.col("t.s"), "seq").alias("first"),
        F.max_by(F.col("h.e") - F.col("t.e"), "seq").alias("last"),
    )
    return got.where("held > 0")


def edge_report(edges: DataFrame, keys: Sequence[str], late_us: int = 1_000_000) -> DataFrame:
    """keys, sentences, edges, edge_over, edge_worst, late, early: counts over the sentences of sentence_edges()."""
    both = F.array_compact(F.array(F.abs("first"), F.abs("last")))
    d = edges.withColumn("__x", both)
    return d.groupBy(*keys).agg(
        F.count("*").alias("sentences"),
        F.sum(F.size("__x")).alias("edges"),
        F.sum(F.size(F.filter("__x", lambda x: x > late_us))).alias("edge_over"),
        F.max(F.array_max("__x")).alias("edge_worst"),
        F.count_if(F.col("first") > late_us).alias("late"),
        F.count_if(F.col("first") < -late_us).alias("early"),
    )


def rollup(verdicts: DataFrame, keys: Sequence[str], verdict: str, owner: str) -> DataFrame:
    """keys, lines, counts of each verdict as a map, owner: the commonest owner of the lines, of equals the least."""
    n = verdicts.groupBy(*keys, verdict).agg(F.count("*").alias("n"))
    counts = n.groupBy(*keys).agg(F.sum("n").alias("lines"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(verdict).alias("k"), "n")))).alias("verdicts"))
    o = verdicts.groupBy(*keys, owner).agg(F.count("*").alias("n")).groupBy(*keys).agg(F.min_by(owner, F.struct(-F.col("n"), F.col(owner))).alias(owner))
    return counts.join(o, list(keys))
