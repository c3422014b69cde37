"""Readings against the best of all ways, places against every start, and the rules for moving lines."""

from itertools import product

import numpy as np
import pytest

from cuelattice.operators import sound as so
from cuelattice.operators.alignment import aligned


def _emissions(seed, frames, symbols):
    p = np.random.default_rng(seed).dirichlet(np.ones(symbols) * 0.4, frames)
    return np.log(np.maximum(p, 1e-9))


def _best(logp, words, t):
    """The best score of all ways through the graph, walked state by state without the operator's arrays."""
    letters = [x for w in words for x in w]
    edge = np.concatenate(([0], np.cumsum([len(w) for w in words]))).tolist()
    stars = so.star_scores(logp, t.delta)

    def score(f, s):
        return logp[f, letters[s[1]]] if s[0] == "on" else logp[f, 0] if s[0] == "off" else stars[f]

    def steps(s):
        kind, k = s
        if kind == "on":
            yield s, 0.0
            yield ("off", k + 1), 0.0
            if k + 1 < len(letters) and letters[k + 1] != letters[k]:
                yield ("on", k + 1), 0.0
        elif kind == "off":
            yield s, 0.0
            if k < len(letters):
                yield ("on", k), 0.0
            if k in edge:
                w = edge.index(k)
                if not t.ends or w in (0, len(words)):
                    yield ("star", w), t.enter
                if t.skip is not None and w < len(words):
                    yield ("off", edge[w + 1]), t.skip * len(words[w])
        else:
            yield s, 0.0
            yield ("off", edge[k]), 0.0

    every = {("off", 0): logp[0, 0], ("on", 0): logp[0, letters[0]], ("star", 0): stars[0] - t.enter}
    for f in range(1, len(logp)):
        new = {}
        for s, v in every.items():
            for to, price in steps(s):
                new[to] = max(new.get(to, -np.inf), v - price + score(f, to))
        every = new
    n = len(letters)
    return max(every.get(s, -np.inf) for s in (("off", n), ("on", n - 1), ("star", len(words))))


@pytest.mark.parametrize("seed", range(25))
def test_readings_are_the_best_of_all(seed):
    r = np.random.default_rng(seed)
    logp = _emissions(seed, int(r.integers(1, 14)), 5)
    words = [r.integers(1, 5, r.integers(1, 4)).tolist() for _ in range(r.integers(1, 4))]
    t = so.Tolerance(delta=float(r.random()), enter=float(r.random() * 3), skip=[None, 0.7][seed % 2], ends=seed % 3 == 0)
    got = so.read(logp, words, t)
    assert got.score == pytest.approx(_best(logp, words, t)) or got.score == _best(logp, words, t)


def test_a_text_as_said_is_read_as_strictly():
    # each letter two loud frames, silence between words: no star and no word left out pays
    said = [0, 1, 1, 2, 2, 0, 3, 3, 1, 1, 0]
    logp = np.log(np.full((len(said), 4), 0.02) + np.eye(4)[said] * 0.92)
    got = so.read(logp, [[1, 2], [3, 1]], so.Tolerance(skip=2.0))
    assert got.placed.all() and not got.starred.any() and (got.spans == aligned(logp, [1, 2, 3, 1])).all()


def test_stars_take_what_nobody_wrote_and_words_unsaid_are_left_out():
    # between the two words a third one is said; the text has one more word that is not said at all
    said = [0, 1, 1, 2, 2, 0, *[3, 3, 2, 2, 1, 1, 3, 3], 0, 3, 3, 1, 1, 0, 0, 0]
    logp = np.log(np.full((len(said), 5), 0.01) + np.eye(5)[said] * 0.95)
    got = so.read(logp, [[1, 2], [3, 1], [4, 4, 4]], so.Tolerance(skip=1.0))
    assert got.placed.tolist() == [True, True, False] and (got.spans[4:] == -1).all()
    assert got.starred[6:14].all() and not got.starred[:5].any() and got.spans[2, 0] == 15
    hard = np.zeros(len(said), bool)
    hard[8:10] = True
    assert not so.read(logp, [[1, 2], [3, 1]], hard=hard).starred[8:10].any()
    assert so.read(logp, [], so.Tolerance()).score == -np.inf and so.read(logp[:0], [[1]]).score == -np.inf


@pytest.mark.parametrize("seed", range(12))
def test_free_places_equal_every_start(seed):
    logp, letters, t = _emissions(seed, 12, 4), [1, 2, 3][: 1 + seed % 3], so.FREE
    stars = so.star_scores(logp, t.delta)
    # every stretch read strictly, silence and stars around it
    best = -np.inf
    for a, b in product(range(12), range(1, 13)):
        if a < b:
            inner = _best(logp[a:b], [letters], so.Tolerance(delta=1e18, enter=1e18, ends=True))
            best = max(best, inner + _outer(stars[:a], logp[:a, 0]) + _outer(stars[b:][::-1], logp[b:, 0][::-1]))
    assert so.read(logp, [letters], t).score == pytest.approx(best)


def _outer(stars, quiet):
    """Frames outside a stretch: stars, and silence next to it after at least one star; none at all, or silence only, too."""
    if not len(stars):
        return 0.0
    return max([quiet.sum(), *(stars[:k].sum() + quiet[k:].sum() for k in range(1, len(stars)))])


def test_lines_go_where_the_sound_holds_them(spark):
    # three lines of ten letters each, the second stands 300 frames late; the last is short and goes as the one before it
    said = np.zeros(900, int)
    texts = [[1, 2, 3, 4, 1, 3, 2, 4, 1, 2], [4, 3, 2, 1, 4, 2, 3, 1, 4, 3], [2, 4, 2]]
    for begin, letters in zip((50, 250, 330), texts):
        for k, x in enumerate(letters):
            said[begin + 4 * k : begin + 4 * k + 3] = x
    logp = np.log(np.full((900, 5), 0.02) + np.eye(5)[said] * 0.9)
    frames = spark.createDataFrame([(1, f, [float(x) for x in v]) for f, v in enumerate(logp)], "key long, frame long, logp array<double>")
    lines = spark.createDataFrame([(1, 0, texts[0], 50, 89), (1, 1, texts[1], 550, 589), (1, 2, texts[2], 630, 641), (2, 0, texts[0], 0, 9)], "key long, line long, letters array<int>, from long, upto long")
    places = so.free_places(lines, frames, ["key"])
    got = {(r.key, r.line): (r.first, r.last, r.moved) for r in so.sound_moves(lines, places, ["key"]).collect()}
    assert got[1, 0] == (50, 89, False) and got[2, 0] == (0, 9, False)
    first, last, moved = got[1, 1]
    assert moved and abs(first - 250) <= 1 and abs(last - 288) <= 1
    assert got[1, 2][2] and abs(got[1, 2][0] - 330) <= 1
    worse = {(r.key, r.line): r.moved for r in so.sound_moves(lines, places, ["key"], least=1.1).collect()}
    assert not any(worse.values())


def test_tolerant_alignment_of_a_table(spark):
    said = [0, 1, 1, 2, 2, 0, *[3, 4] * 10, 0, 3, 3, 1, 1, 0]
    logp = np.log(np.full((len(said), 5), 0.01) + np.eye(5)[said] * 0.95)
    rows = [(7, f, [float(x) for x in v], [[1, 2], [3, 1]]) for f, v in enumerate(logp)]
    d = spark.createDataFrame(rows, "key long, frame long, logp array<double>, words array<array<int>>")
    got = {(r.kind, r.word): (r.first, r.last) for r in so.tolerant_alignment(d, ["key"]).collect()}
    assert got["word", 0] == (1, 4) and got["word", 1][0] >= 26
    first, last = got["star", None]
    assert first <= 7 and last >= 24
