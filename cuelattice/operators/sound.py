"""Letters in the sound where the text is not quite what was said, and lines that go where the sound holds them.

A reading is a way through the frames: letters in order, silences (the blank) before, between and behind them, stars that
take any sound, and words that are left out. Frames of one request are a task; what is decided from line to line is a window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .alignment import aligned


@dataclass(frozen=True)
class Tolerance:
    """Prices, in logarithms: a star's frame is delta below the loudest letter, entering one costs enter, leaving a word out skip for each letter (none: never).

    ends: stars at both ends of the text only, not between words. outside: for each frame of a letter outside its bounds.
    """

    delta: float = 1.0
    enter: float = 4.0
    skip: float | None = None
    ends: bool = False
    outside: float = 3.0


@dataclass
class Reading:
    """First and last frame of each letter (-1 where its word is left out), which words are placed, the frames that a star took, and the sum of scores."""

    spans: np.ndarray
    placed: np.ndarray
    starred: np.ndarray
    score: float


def star_scores(logp: np.ndarray, delta: float, blank: int = 0, hard: np.ndarray | None = None) -> np.ndarray:
    """What a star gets in each frame: the blank's score, or the loudest letter's less delta; nothing in certain silence."""
    loud = np.delete(logp, blank, axis=1).max(axis=1, initial=-np.inf) - delta
    star = np.maximum(logp[:, blank], loud)
    return star if hard is None else np.where(hard, -np.inf, star)


def read(logp: np.ndarray, words: Sequence[Sequence[int]], t: Tolerance = Tolerance(), blank: int = 0, bounds: np.ndarray | None = None, hard: np.ndarray | None = None) -> Reading:
    """The best reading of the words (letters of each) in the frames.

    on[k] is the best score of a frame that sounds letter k, off[k] that of silence before letter k (or behind the last), star[w]
    that of a star beside the silence before word w (or behind the last). A star is entered from its silence and left to it; a
    word is left out by a step from the silence before it to that behind it.
    """
    letters = [x for w in words for x in w]
    n, frames = len(letters), len(logp)
    edge = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(int)
    spans, placed, starred = np.full((n, 2), -1), np.zeros(len(words), bool), np.zeros(frames, bool)
    if not n or not frames:
        return Reading(spans, placed, starred, -np.inf)
    low = -np.inf
    sound = logp[:, letters].astype(float)
    if bounds is not None:
        at = np.arange(frames)[:, None]
        sound = sound - t.outside * ((at < bounds[:, 0]) | (at > bounds[:, 1]))
    differs = np.array([False, *(a != b for a, b in zip(letters, letters[1:], strict=False))])
    quiet, loud = logp[:, blank].astype(float), star_scores(logp.astype(float), t.delta, blank, hard)
    allowed = np.ones(len(edge), bool)
    if t.ends:
        allowed[1:-1] = False
    left_out = np.full(len(words), np.inf) if t.skip is None else t.skip * np.diff(edge)
    on, off, star = np.full(n, low), np.full(n + 1, low), np.full(len(edge), low)
    on[0], off[0] = sound[0, 0], quiet[0]
    if allowed[0]:
        star[0] = loud[0] - t.enter
    # where each comes from; letters: 0 itself, 1 silence, 2 the letter before; silences: 0 itself, 1 a letter, 2 a star, 3 a word left out; stars: 0 itself, 1 silence
    moves = [(np.zeros(n, np.int8), np.zeros(n + 1, np.int8), np.zeros(len(edge), np.int8))]
    for f in range(1, frames):
        ways = np.stack((on, off[:-1], np.where(differs, np.append(low, on[:-1]), low)))
        from_on = ways.argmax(0)
        skipped = np.full(n + 1, low)
        skipped[edge[1:]] = off[edge[:-1]] - left_out
        starred_off = np.full(n + 1, low)
        starred_off[edge] = star
        back = np.stack((off, np.append(low, on), starred_off, skipped))
        from_off = back.argmax(0)
        into = np.stack((star, np.where(allowed, off[edge] - t.enter, low)))
        from_star = into.argmax(0)
        moves.append((from_on.astype(np.int8), from_off.astype(np.int8), from_star.astype(np.int8)))
        on, off, star = ways.max(0) + sound[f], back.max(0) + quiet[f], into.max(0) + loud[f]
    ends = (off[-1], on[-1], star[-1])
    kind = int(np.argmax(ends))
    score = float(ends[kind])
    if score == -np.inf:
        return Reading(spans, placed, starred, score)
    kind, k = ("off", "on", "star")[kind], (n, n - 1, len(words))[kind]
    for f in range(frames - 1, -1, -1):
        from_on, from_off, from_star = moves[f]
        if kind == "on":
            spans[k, 0] = f
            spans[k, 1] = max(spans[k, 1], f)
            if from_on[k] == 1:
                kind = "off"
            elif from_on[k] == 2:
                k -= 1
        elif kind == "off":
            step = from_off[k]
            if step == 1:
                kind, k = "on", k - 1
            elif step == 2:
                kind, k = "star", int(np.searchsorted(edge, k))
            elif step == 3:
                k = int(edge[np.searchsorted(edge, k) - 1])
        else:
            starred[f] = True
            if from_star[k] == 1:
                kind, k = "off", int(edge[k])
    for w in range(len(words)):
        placed[w] = edge[w] < edge[w + 1] and (spans[edge[w] : edge[w + 1], 0] >= 0).all()
    return Reading(spans, placed, starred, score)


def tolerant_alignment(emissions: DataFrame, keys: Sequence[str], tolerance: Tolerance = Tolerance(), least: int = 15) -> DataFrame:
    """keys, kind, word, first, last: the frames of each word that is placed ("word"), and stretches of at least so many frames that a star took ("star").

    emissions has keys, frame, logp and words (an array of each word's letters, the same in each row); if it has a column
    hard, true in frames of certain silence, no star takes them. A word that is left out has no frames.
    """
    kinds = dict(emissions.dtypes)

    def run(clip: pd.DataFrame) -> pd.DataFrame:
        clip = clip.sort_values("frame")
        words = [list(w) for w in clip["words"].iloc[0]]
        hard = clip["hard"].to_numpy(bool) if "hard" in clip else None
        got, frame = read(np.array(clip["logp"].tolist(), float), words, tolerance, hard=hard), clip["frame"].to_numpy()
        rows, at = [], 0
        for w, letters in enumerate(words):
            own = got.spans[at : at + len(letters)]
            at += len(letters)
            rows.append(("word", w, frame[own[:, 0].min()], frame[own[:, 1].max()]) if got.placed[w] else ("word", w, None, None))
        turns = np.flatnonzero(np.diff(np.concatenate(([0], got.starred.astype(np.int8), [0]))))
        rows += [("star", None, frame[a], frame[b - 1]) for a, b in zip(turns[::2], turns[1::2], strict=True) if b - a >= least]
        out = pd.DataFrame(rows, columns=["kind", "word", "first", "last"]).astype({"word": "Int32", "first": "Int64", "last": "Int64"})
        for k in reversed(keys):
            out.insert(0, k, clip[k].iloc[0])
        return out

    return emissions.groupBy(*keys).applyInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "kind string, word int, first long, last long"]))


#: Stars at both ends, at no price to enter: a text is looked for anywhere in the frames.
FREE = Tolerance(enter=0.0, ends=True)


def heard_at(logp: np.ndarray, letters: Sequence[int], spans: np.ndarray) -> float:
    """How well the letters are heard where they are placed: the mean probability of their frames, each letter counting once."""
    if not len(spans) or (spans[:, 0] < 0).any():
        return 0.0
    return float(np.mean([np.exp(logp[a : b + 1, x]).mean() for x, (a, b) in zip(letters, spans, strict=True)]))


def free_places(lines: DataFrame, emissions: DataFrame, keys: Sequence[str], tolerance: Tolerance = FREE) -> DataFrame:
    """keys, line, first, last, found, here, size: where the sound of the request (keys) holds each line best, how well it is heard there, and where it stands; size: its letters.

    lines has keys, line, letters and its frames from and upto; emissions has keys, frame and logp. The request's frames go to
    one task once for all of its lines.
    """
    kinds = dict(lines.dtypes)
    own = lines.select(*keys, "line", "letters", F.col("from").cast("long").alias("from"), F.col("upto").cast("long").alias("upto"))

    def run(asked: pd.DataFrame, sound: pd.DataFrame) -> pd.DataFrame:
        sound = sound.sort_values("frame")
        logp, frame = np.array(sound["logp"].tolist(), float), sound["frame"].to_numpy()
        rows = []
        for line, letters, a, b in asked[["line", "letters", "from", "upto"]].itertuples(index=False, name=None):
            letters = list(letters)
            got = read(logp, [letters], tolerance) if len(frame) and letters else None
            found = got is not None and got.placed[0]
            inside = logp[(frame >= a) & (frame <= b)] if len(frame) else logp
            here = heard_at(inside, letters, aligned(inside, letters)) if letters and len(inside) else 0.0
            rows.append((line, frame[got.spans[0, 0]] if found else None, frame[got.spans[-1, 1]] if found else None, heard_at(logp, letters, got.spans) if found else None, here, len(letters)))
        out = pd.DataFrame(rows, columns=["line", "first", "last", "found", "here", "size"]).astype({"first": "Int64", "last": "Int64"})
        for k in reversed(keys):
            out.insert(0, k, asked[k].iloc[0] if len(asked) else None)
        return out

    ddl = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"line {kinds['line']}, first long, last long, found double, here double, size long"])
    return own.groupBy(*keys).cogroup(emissions.select(*keys, "frame", "logp").groupBy(*keys)).applyInPandas(run, ddl)


def sound_moves(lines: DataFrame, places: DataFrame, keys: Sequence[str], reach: int = 100, few: int = 8, least: float = 0.4, better: float = 0.15, follows: float = 0.6) -> DataFrame:
    """lines (line, from, upto) with first, last and moved: those heard clearly out of reach of where they stand go where free_places() found them.

    A line must be heard well there, and better than where it stands, unless the search followed the whole request: then
    its lines, weighed by letters, are heard well in the mean. A line of few letters goes as the one before it went; the last
    decision is carried over such lines by a window.
    """
    d = lines.join(places.select(*keys, "line", "first", "last", "found", "here", "size"), [*keys, "line"], "left")
    request, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("from", "line")
    weighed = F.when(F.col("found").isNotNull(), F.col("size"))
    whole = F.coalesce(F.sum(weighed * F.col("found")).over(request) >= follows * F.sum(weighed).over(request), F.lit(False))
    out = F.coalesce(F.greatest(F.abs(F.col("first") - F.col("from")), F.abs(F.col("last") - F.col("upto"))) > reach, F.lit(False))
    well = (F.col("found") >= least) & (F.col("found") >= F.col("here") + F.when(whole, 0.0).otherwise(better))
    own = F.when(~out, False).when(F.col("size") >= few, well)
    d = d.withColumn("__own", own)
    d = d.withColumn("moved", F.coalesce(F.last("__own", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))
    to = lambda c, old: F.when(F.col("moved"), F.col(c)).otherwise(F.col(old))
    return d.select(*lines.columns, to("first", "from").alias("first"), to("last", "upto").alias("last"), "moved")
