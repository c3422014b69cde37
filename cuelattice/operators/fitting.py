"""Cues on a clip's time line: which share the screen, and how long each is shown.

Which cues share the screen is a cheapest partition: a clip's cues are parted into runs that may be shown as one, and a
run's price says what it takes to show it for the shortest time between its neighbours: nothing, a little before its first
word, past a cut of the picture, the next one late, or held while the next one waits. Times follow from front to back, and
neighbours then trade time where one could not be read and the other has some to spare.

Stretches of a clip that cannot push each other are found by running maxima and are groups of their own.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import inf

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .alignment import each_clip
from .intervals import overlap_join


@dataclass(frozen=True)
class Limits:
    """Times in milliseconds, sizes in characters."""

    shortest: int = 900
    longest: int = 6000
    gap: int = 83
    linger: int = 400
    lead: int = 200
    late: int = 200
    over_cut: int = 2000
    line: int = 42
    one: int = 84
    voices: int = 2
    readable: int = 900
    join_gap: int = 1000


#: Prices, each above what the ones before it can add up to around one cue.
LEAD, JOIN, SHORT, CUT, LATE, HELD = 1, 10, 40, 200, 600, 2000


@dataclass
class Cue:
    number: int
    label: str | None
    text: str
    start: int
    end: int
    read: int = 0


@dataclass
class Shown:
    """Cues as one: when they are shown, when their words begin and end, and the cues of each part."""

    start: int
    end: int
    first: int
    said: int
    read: int
    parts: list[list[Cue]]

    @property
    def texts(self) -> list[str]:
        return [" ".join(c.text for c in part) for part in self.parts]

    @property
    def numbers(self) -> list[int]:
        return [c.number for part in self.parts for c in part]


class Line:
    """A stretch of cues in order, and the cuts of the picture."""

    def __init__(self, cues: list[Cue], cuts: list[int], r: Limits):
        self.cues, self.cuts, self.r = sorted(cues, key=lambda c: (c.start, c.number)), sorted(cuts), r
        self.reach = [-inf]
        for c in self.cues:
            self.reach.append(max(self.reach[-1], c.end))

    def begins(self, at: int) -> float:
        return self.cues[at].start if at < len(self.cues) else inf

    def cut_after(self, at: float) -> float:
        k = bisect_right(self.cuts, at)
        return self.cuts[k] if k < len(self.cuts) else inf

    def cut_upto(self, at: float) -> float:
        k = bisect_right(self.cuts, at)
        return self.cuts[k - 1] if k else -inf

    def parted(self, a: Cue, b: Cue) -> bool:
        """Whether the picture changes between the words of two cues."""
        k = bisect_left(self.cuts, a.end)
        return k < len(self.cuts) and self.cuts[k] <= b.start

    def parts(self, low: int, high: int) -> list[list[Cue]] | None:
        """The cues low to high by voice, if they may be one: a voice within a cue's size, several within a line each."""
        r, run = self.r, self.cues[low:high]
        parts, across = [[run[0]]], False
        for a, b in zip(run, run[1:], strict=False):
            cut = self.parted(a, b)
            across |= cut
            same = a.label == b.label if a.label or b.label else not cut
            if same:
                parts[-1].append(b)
            else:
                parts.append([b])
        if len(run) == 1:
            return parts
        if max(c.end for c in run) - run[0].start > (r.over_cut if across else r.longest) or len(parts) > r.voices:
            return None
        most = r.one if len(parts) == 1 else r.line
        return parts if all(sum(len(c.text) + 1 for c in p) - 1 <= most for p in parts) else None

    def early(self, low: int) -> float:
        """How much before its first word the cue at low may be shown: not over a cut nor into what was said before."""
        at = self.cues[low].start
        return max(0, at - max(at - self.r.lead, self.cut_upto(at), min(at, self.reach[low] + self.r.gap)))

    def bounds(self, low: int, high: int) -> Iterator[tuple[int, float]]:
        """(price, end at the latest) of the ways to show the cues low to high, the dearest last."""
        said = max(c.end for c in self.cues[low:high])
        before = self.begins(high) - self.r.gap
        yield 0, min(before, self.cut_after(said))
        yield CUT, before
        if before < inf:
            yield LATE, max(before, min(self.begins(high) + self.r.late, self.begins(high + 1)) - self.r.gap)

    def price(self, low: int, high: int) -> float:
        r, first = self.r, self.cues[low].start
        cost = JOIN * (high - low - 1)
        if self.reach[high] - first < r.readable and self.could_join(low, high):
            cost += SHORT
        for extra, end in self.bounds(low, high):
            missing = r.shortest - (end - first)
            if missing <= self.early(low):
                return cost + extra + (LEAD if missing > 0 else 0)
        return cost + HELD + missing - self.early(low)

    def could_join(self, low: int, high: int) -> bool:
        """Whether a neighbour close by could be shown with these cues."""
        near = lambda a, b: self.cues[b].start - self.cues[a].end <= self.r.join_gap
        after = high < len(self.cues) and near(high - 1, high) and self.parts(low, high + 1) is not None
        return after or (low > 0 and near(low - 1, low) and self.parts(low - 1, high) is not None)

    def partition(self) -> list[tuple[int, int]]:
        """The cheapest way to part the cues into runs that may be shown as one; of equals the one with shorter last runs."""
        cost, came = [0.0], [0]
        for high in range(1, len(self.cues) + 1):
            best, at = inf, high - 1
            for low in range(high - 1, -1, -1):
                if self.parts(low, high) is None:
                    break
                if (total := cost[low] + self.price(low, high)) < best:
                    best, at = total, low
            cost.append(best)
            came.append(at)
        runs, high = [], len(self.cues)
        while high:
            runs.append((came[high], high))
            high = came[high]
        return runs[::-1]

    def timed(self) -> list[Shown]:
        """Every run with its times, from front to back; each is shown the shortest time at least, and a gap apart."""
        r, out = self.r, []
        for low, high in self.partition():
            run, first = self.cues[low:high], self.cues[low].start
            floor = out[-1].end + r.gap if out else -inf
            start = int(max(first, floor))
            spare = max(0, min(self.early(low), start - floor))
            said = max(c.end for c in run)
            end = start + r.shortest
            for _, latest in self.bounds(low, high):
                missing = r.shortest - (latest - start)
                if missing <= spare:
                    start -= int(max(0, missing))
                    end = int(min(max(said + r.linger, start + r.shortest), start + r.longest, latest))
                    break
            out.append(Shown(start, end, first, said, sum(c.read for c in run), self.parts(low, high)))
        return self.traded(out)

    def traded(self, shown: list[Shown]) -> list[Shown]:
        """A run that is up too short to be read gets time of the next one: what that can spare; or both get their share, if neither can be read."""
        r = self.r
        for k, (a, b) in enumerate(zip(shown, shown[1:], strict=False)):
            wanted = min(a.read, r.longest) - (a.end - a.start)
            if wanted <= 0 or a.end + r.gap < b.start:
                continue
            same = a.parts[-1][-1].label == b.parts[0][0].label
            # the next may wait until these words are said; of the same voice a little only, behind an exchange
            until = (b.first + r.late if len(a.parts) > 1 else b.start) if same else a.said + r.gap
            if k + 2 < len(shown):
                until = min(until, shown[k + 2].first)
            spare = b.end - b.start - max(b.read, r.shortest)
            if spare < 0 and a.read + b.read:
                spare = min(a.start + (b.end - a.start) * a.read // (a.read + b.read) - b.start, b.end - b.start - r.shortest)
            given = int(min(wanted, spare, until - b.start))
            if given > 0:
                a.end, b.start = a.end + given, b.start + given
        return shown


def laid_out(cues: list[Cue], cuts: list[int], r: Limits = Limits()) -> list[Shown]:
    """Cues as they are shown, in order."""
    return Line(cues, cuts, r).timed()


def stretches(cues: DataFrame, keys: Sequence[str], r: Limits, rest: int = 10_000) -> DataFrame:
    """cues (number, start_ms, end_ms) with stretch: a new one where nothing before can be shown so late that it pushes the cue.

    The k-th cue is shown by k times the shortest time after any cue before it at the latest, so a running maximum says
    how far a crowd of cues reaches.
    """
    w = Window.partitionBy(*keys).orderBy("start_ms", "number")
    each = r.shortest + r.gap
    d = cues.withColumn("__k", F.row_number().over(w))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    pushed = F.max(F.col("start_ms") - F.col("__k") * each).over(before) + F.col("__k") * each
    d = d.withColumn("__free", F.greatest(pushed, F.max("end_ms").over(before)) + rest)
    fresh = F.when(F.col("__free").isNull() | (F.col("start_ms") > F.col("__free")), 1).otherwise(0)
    return d.withColumn("__fresh", fresh).withColumn("stretch", F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__k", "__free", "__fresh")


_PARTS = "array<array<struct<number: bigint, label: string, text: string, start_ms: bigint, end_ms: bigint>>>"


def fit_cues(cues: DataFrame, keys: Sequence[str], cuts: DataFrame | None = None, limits: Limits = Limits(), rate: float = 5.0) -> DataFrame:
    """keys, number, start_ms, end_ms, text, parts, joined: the cues (number, label, text, start_ms, end_ms) as they are shown.

    cuts (at_ms) are changes of the picture. parts has, voice by voice, the cues that are shown in one, and text a line for each;
    joined says how many they are. rate: words read in a second.
    """
    r = limits
    d = cues.select(*keys, "number", "label", "text", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), F.round(tx.reading_seconds(F.col("text"), rate) * 1000).cast("long").alias("read"))
    d = stretches(d, keys, r)
    if cuts is None:
        d = d.withColumn("cuts", F.array().cast("array<bigint>"))
    else:  # only cuts near a cue matter to it
        reach = r.longest + r.shortest
        near = overlap_join(d.select(*keys, "number", (F.col("start_ms") - reach).alias("s"), (F.col("end_ms") + reach).alias("e")), cuts.select(*keys, F.col("at_ms").cast("long").alias("s"), F.col("at_ms").cast("long").alias("e")), keys, 4 * reach, closed=True)
        d = d.join(near.groupBy(*keys, "number").agg(F.collect_set("b_s").alias("cuts")), [*keys, "number"], "left")
    def rows(part: list[tuple]) -> Iterator[tuple]:
        own = [Cue(n, label, said, s, e, read) for n, label, said, s, e, read, _ in part]
        at = {x for *_, c in part for x in c or ()}
        for g in laid_out(own, sorted(at), r):
            told = [[(c.number, c.label, c.text, c.start, c.end) for c in p] for p in g.parts]
            yield g.numbers[0], g.start, g.end, "\n".join(g.texts), told, len(g.numbers)

    # read one after the other: most stretches are too short for a frame of their own
    d = d.select(*keys, "stretch", "number", "label", "text", "start_ms", "end_ms", "read", "cuts")
    got = each_clip(d, [*keys, "stretch"], ["start_ms", "number"], rows, f"number long, start_ms long, end_ms long, text string, parts {_PARTS}, joined int")
    return got.drop("stretch")
