import random
from itertools import combinations, groupby, permutations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelattice.operators import alignment as al
from cuelattice.operators import build as bu
from cuelattice.operators import cues as cu
from cuelattice.operators import evidence as ev
from cuelattice.operators import fitting as fi
from cuelattice.operators import speakers as sp
from cuelattice.operators import truth as tu
from cuelattice.operators import voices as vo

WORDS = "key long, pass long, line long, seq long, token string, s long, e long"


def _pass(key, p, text, line_words=4):
    return [(key, p, i // line_words, i, t, i * 1_000_000, i * 1_000_000 + 900_000) for i, t in enumerate(text.split())]


def _vote(spark, rows):
    w = spark.createDataFrame(rows, WORDS)
    return sorted((r.line, r.confirmed, r.words) for r in al.vote(w, ["key"]).collect())


def test_a_majority_confirms(spark):
    base = "one two three four alone here nobody else five six seven eight nine"
    rows = _pass(1, 7, base) + _pass(1, 8, base.replace("alone here nobody else", "some other words then")) + _pass(1, 9, base.replace("alone here nobody else", "quite another thing now"))
    assert _vote(spark, rows) == [(0, 4, 4), (2, 4, 4), (3, 1, 1)]
    # the order in which passes come makes no difference
    again = [(k, 16 - p, *rest) for k, p, *rest in rows]
    assert _vote(spark, again) == [(0, 4, 4), (2, 4, 4), (3, 1, 1)]


def test_witnesses_are_null_without_another_pass(spark):
    w = spark.createDataFrame(_pass(1, 0, "a b c") + _pass(2, 0, "a b c d") + _pass(2, 1, "a x c"), WORDS)
    got = {(r.key, r.seq): r.backed for r in al.witnesses(w, ["key"]).collect()}
    assert got == {(1, 0): None, (1, 1): None, (1, 2): None, (2, 0): 1, (2, 1): 0, (2, 2): 1, (2, 3): 0}


@pytest.mark.parametrize("seed", range(8))
def test_edit_path_is_as_short_as_can_be(seed):
    r = random.Random(seed)
    a, b = (["abc"[r.randrange(3)] for _ in range(r.randrange(9))] for _ in range(2))
    steps = al.edit_steps(a, b)
    dist = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            dist[i, j] = max(i, j) if 0 in (i, j) else min(dist[i - 1, j] + 1, dist[i, j - 1] + 1, dist[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
    assert sum(s != "ok" for s, _, _ in steps) == dist[-1, -1]
    assert [b[j] for s, _, j in steps if s != "del"] == b and [a[i] for s, i, _ in steps if s != "ins"] == a


def test_linkage():
    v = np.array([[1, 0], [0.99, 0.1], [0, 1], [0.1, 0.99], [-1, 0.0]])
    label = al.linked(v, 0.8)
    assert label[0] == label[1] != label[2] == label[3] and len(set(label)) == 3
    assert len(set(al.linked(v, 1.1))) == 5 and len(set(al.linked(v, -1.1))) == 1


def test_ties_of_the_edit_path_go_to_deletions():
    # read from the end: a word is deleted before one is inserted
    assert al.edit_steps(["a", "b"], ["b", "a"]) == [("sub", 0, 0), ("sub", 1, 1)]
    assert al.edit_steps(["a", "b", "c"], ["b", "c", "d"])[-1][0] == "ins"
    for cells in (0, 1_000_000):
        assert al.edit_steps(list("abab"), list("baba"), cells) == al.edit_steps(list("abab"), list("baba"))
    table = np.array([[0, 1, 2], [1, 1, 1], [2, 1, 2]])  # said "x b", wrote "b y": sub sub, or del ok ins
    assert table[-1, -1] == sum(s != "ok" for s, _, _ in al.edit_steps(["x", "b"], ["b", "y"]))
    assert [s for s, _, _ in al.edit_steps(["x", "b"], ["b", "y"])] == ["sub", "sub"]


@pytest.mark.parametrize("seed", range(30))
def test_letters_take_the_likeliest_way(seed):
    r = np.random.default_rng(seed)
    letters = [[1, 2], [1, 1], [2], [1, 2, 1]][seed % 4]
    logp = r.normal(size=(6, 3))
    bounds = np.array([[0, 4], [1, 5], [2, 5]])[: len(letters)] if seed % 3 == 0 else None
    want, best = [], -np.inf
    for path in product(range(3), repeat=6):  # 0 is silence
        runs = [(k, list(g)) for k, g in groupby(enumerate(path), key=lambda x: x[1])]
        said = [(k, g[0][0], g[-1][0]) for k, g in runs if k]
        if [k for k, _, _ in said] != letters or bounds is not None and any(a < lo or b > hi for (_, a, b), (lo, hi) in zip(said, bounds)):
            continue
        score = sum(logp[t, k] for t, k in enumerate(path))
        if score > best:
            best, want = score, [[a, b] for _, a, b in said]
    assert al.aligned(logp, letters, bounds=bounds).tolist() == (want or [[-1, -1]] * len(letters))


def test_what_can_not_be_said_and_silence():
    assert al.aligned(np.zeros((1, 3)), [1, 1]).tolist() == [[-1, -1]] * 2 and al.aligned(np.zeros((0, 3)), [1]).tolist() == [[-1, -1]]
    quiet = al.silenced(np.zeros((3, 3)), np.array([0, 1, 2]), [9.0, 2.0, 0.0])
    assert quiet.tolist() == [[0, -9, -9], [0, -2, -2], [0, 0, 0]]


def test_letters_of_clips_keep_their_bounds(spark):
    rows = [(1, t, [0.0, float(t == 5), float(t == 7)], [1, 2], [(6, 8), (6, 9)], 2) for t in range(3, 10)]
    d = spark.createDataFrame(rows, "key long, frame long, logp array<double>, labels array<int>, bounds array<struct<first: long, last: long>>, tier int")
    got = [(r.place, r.first >= 6, r.last) for r in al.forced_alignment(d, ["key"], penalty=[9.0, 1.0, 0.0]).collect()]
    assert got[0][:2] == (0, True) and got[1][0] == 1 and got[1][2] >= 7


def test_extra_lines_and_what_stands(spark):
    base = "one two three four five six seven eight nine ten"
    mid = "well then quite so"
    rows = _pass(1, 0, base)
    # two passes of three heard four words in a line that the fullest one missed
    for p in (1, 2):
        w = _pass(1, p, "one two three four five six seven eight")
        rows += w + [(1, p, 9, 100 + i, t, 60_000_000 + i * 1_000_000, 60_900_000 + i * 1_000_000) for i, t in enumerate(mid.split()[: 4 if p == 1 else 3])]
    rows = [r for r in rows]
    w = spark.createDataFrame(rows + [(1, 0, 3, 50 + i, f"only{i}", 200_000_000 + i, 200_000_900 + i) for i in range(6)], WORDS)
    got = [(r["pass"], r.line) for r in al.extra_lines(w, ["key"]).collect()]
    assert got == [(1, 9)]
    # passes as full as each other whose vote keeps little: the fullest stands
    far = [(2, p, i, i, t, (i + 40 * p) * 1_000_000, (i + 40 * p) * 1_000_000 + 900_000) for p in range(3) for i, t in enumerate(base.split())]
    w = spark.createDataFrame(far, WORDS)
    voted = al.vote(w, ["key"])
    stand = al.settled(w, ["key"], voted).collect()
    assert voted.count() == 0 and len(stand) == 10 and {r["pass"] for r in stand} == {0}


def test_support(spark):
    runs = spark.createDataFrame([(1, 0, "a b c d".split()), (1, 1, "x y a z".split())], "key long, run long, said array<string>")
    local = spark.createDataFrame([(1, "q a b c".split())], "key long, said array<string>")
    assert sorted((r.run, r.support) for r in al.support(runs, local, ["key"]).collect()) == [(0, 2.5), (1, -2.0)]


@pytest.mark.parametrize("seed", range(40))
def test_labels_are_paired_best(seed):
    r = np.random.default_rng(seed)
    count = r.integers(0, 9, (r.integers(1, 6), r.integers(1, 6)))
    got = sp.best_pairs(count)
    n, m = count.shape
    slots = list(range(m)) + [None] * n
    best = max(sum(count[i, c] for i, c in enumerate(p) if c is not None) for p in set(permutations(slots, n)))
    assert sum(count[i, j] for i, j in got) == best and len({i for i, _ in got}) == len({j for _, j in got}) == len(got)


def test_names_are_given_once(spark):
    d = spark.createDataFrame([(1, "x", "A", 5), (1, "y", "A", 4), (1, "y", "B", 1), (1, "x", "B", 4)], "key long, t string, h string, n long")
    assert sorted((r.t, r.h) for r in sp.named_greedily(d, ["key"], "t", "h", "n").collect()) == [("x", "A"), ("y", "B")]


@pytest.mark.parametrize("seed", range(40))
def test_words_match_the_truth_as_well_as_can_be(seed):
    r = random.Random(seed)
    a, b = (["abc"[r.randrange(3)] for _ in range(r.randrange(6))] for _ in range(2))
    at, there = (np.cumsum([r.randrange(1, 30) for _ in x]).astype(float) for x in (a, b))
    cost = 0.5 / (min(len(a), len(b)) + 1) / 60
    worth = lambda p: sum(1 - cost * min(abs(at[i] - there[j]), 60) for i, j in p)
    every = [(i, j) for i in range(len(a)) for j in range(len(b)) if a[i] == b[j]]
    best = max((worth(p) for n in range(len(every) + 1) for p in combinations(every, n) if all(x[0] < y[0] and x[1] < y[1] for x, y in zip(p, p[1:]))), default=0)
    got = tu.matched(a, b, at, there)
    assert set(got) <= set(every) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:])) and abs(worth(got) - best) < 1e-9


def test_sentence_homes_with_overlaps(spark):
    r = random.Random(5)
    sentences = [(1, k, s := r.randrange(1000), s + r.randrange(1, 200), r.choice("AB")) for k in range(25)]
    words = [(1, i, s := r.randrange(1200), s + r.randrange(0, 20), r.choice("ABC")) for i in range(120)]
    s = spark.createDataFrame(sentences, "key long, line long, s long, e long, label string")
    w = spark.createDataFrame(words, "key long, id long, s long, e long, label string")
    got = {x.id: x.home for x in ev.sentence_home(w, s, ["key"], 10_000, width=97).collect()}
    for _, i, a, b, label in words:
        m = (a + b) // 2
        assert got[i] == min((max(x - m, m - y, 0) + (0 if who == label else 10_000), k) for _, k, x, y, who in sentences)[1]


def test_many_labels_are_compared_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(i, f"l{i % 40:02}", v.tolist()) for i, v in enumerate(r.normal(size=(160, 6)))]
    d = spark.createDataFrame(rows, "id long, label string, vec array<double>")
    both = lambda: {k: v for x in vo.leave_one_out(d).collect() for k, v in (((x.id, 0), x.own), ((x.id, 1), x.rival))}
    want = both()
    near = {x.id: (x.near, x.similarity) for x in vo.nearest(d).collect()}
    flat = {x.id: x.silhouette for x in vo.silhouette(d).collect()}
    monkeypatch.setattr(vo, "BOUND", 300)
    monkeypatch.setattr(vo, "PRINTS", 50)
    assert both() == pytest.approx(want)
    assert {x.id: x.near for x in vo.nearest(d).collect()} == {i: n for i, (n, _) in near.items()}
    assert {x.id: x.silhouette for x in vo.silhouette(d).collect()} == pytest.approx(flat)


def _words(seed, n):
    r, at, out = random.Random(seed), 0, []
    for i in range(n):
        at += r.choice([0, 50_000, 400_000, 3_000_000])
        end = at + r.randrange(100_000, 600_000)
        out.append((1, i, f"word{i}" + r.choice(["", "", ",", "."]), at, end, "AB"[i // 9 % 2]))
        at = end
    return out


def test_cues_hold_all_words_and_keep_their_bounds(spark):
    d = spark.createDataFrame(_words(3, 160), "key long, id long, text string, s long, e long, label string")
    cues = bu.build_cues(d, ["key"])
    got = cues.orderBy("number").collect()
    assert " ".join(c.text for c in got).split() == [w[2] for w in _words(3, 160)]
    assert all(len(c.text) <= 84 and c.end_ms - c.start_ms <= 6001 for c in got)
    fit = fi.fit_cues(cues, ["key"]).orderBy("start_ms").collect()
    assert sum(c.joined for c in fit) == len(got) and " ".join(c.text for c in fit).split() == [w[2] for w in _words(3, 160)]
    for a, b in zip(fit, fit[1:]):
        assert a.end_ms + 83 <= b.start_ms
    assert all(900 <= c.end_ms - c.start_ms <= 6200 for c in fit)
    assert bu.build_cues(d.limit(0), ["key"]).count() == 0


def test_replies_over_another(spark):
    rows = [(1, 0, "a", 0, 9_000_000, "A"), (1, 1, "yes", 3_000_000, 3_500_000, "B"), (1, 2, "b", 9_500_000, 10_000_000, "A"), (1, 3, "late", 9_900_000, 10_500_000, "B")]
    d = spark.createDataFrame(rows, "key long, id long, text string, s long, e long, label string")
    assert [r.id for r in bu.said_over(d, ["key"]).where("over").collect()] == [1]


def test_piece_plan_cuts_in_pauses(spark):
    clips = spark.createDataFrame([(1, 200_000), (2, 10_000)], "key long, length long")
    pauses = spark.createDataFrame([(1, 70_000, 71_000), (1, 76_000, 79_000), (1, 140_000, 140_500)], "key long, s long, e long")
    got = sorted((r.key, r.piece, r.s, r.e) for r in cu.piece_plan(clips, pauses, ["key"], 75_000, most=15_000).collect())
    assert got == [(1, 0, 0, 77_500), (1, 1, 77_500, 140_250), (1, 2, 140_250, 200_000), (2, 0, 0, 10_000)]


def test_witnesses_in_bands_equal_their_definition(spark):
    from difflib import SequenceMatcher

    r, near, stretch = random.Random(7), 4_000_000, 30
    at, base, others = 0, [], []
    for k in range(150):
        at += r.randrange(100_000, 900_000)
        token = r.choice("a b c d e f".split() + [""])
        base.append((1, k, token, at, at + 300_000))
        for p in (1, 2):
            if r.random() > 0.3:
                t = token if r.random() > 0.2 else r.choice("a b c".split())
                shift = r.choice([0, 0, 200_000, 6_000_000])
                others.append((1, p, 1000 * p + k, t, at + shift, at + shift + 300_000))
    base.append((2, 0, "a", 0, 5))
    want = {(2, 0): None}
    for first in range(0, 150, stretch):
        part = base[first : first + stretch]
        low, high = part[0][3] - near, max(x[4] for x in part) + near
        for x in part:
            want[x[:2]] = 0 if x[2] else None
        for p in (1, 2):
            said = sorted((x for x in others if x[1] == p and x[5] >= low and x[4] <= high), key=lambda x: (x[4], x[2]))
            for i, j, n in SequenceMatcher(None, [x[2] for x in part], [x[3] for x in said], autojunk=False).get_matching_blocks():
                for k in range(n):
                    word, by = part[i + k], said[j + k]
                    if word[2] and by[4] - near <= word[3] <= by[5] + near:
                        want[word[:2]] += 1
    b = spark.createDataFrame(base, "key long, seq long, token string, s long, e long")
    o = spark.createDataFrame(others, "key long, pass int, seq long, token string, s long, e long")
    got = {(x.key, x.seq): x.backed for x in al.banded_witnesses(b, o, ["key"], near, stretch).collect()}
    assert got == want


def test_the_hearing_that_stands(spark):
    def words(key, *passes):
        return [(key, p, line, seq, t, 10 * line + seq, 10 * line + seq + 1) for p, lines in enumerate(passes) for seq, (line, t) in enumerate((line, t) for line, said in enumerate(lines) for t in said.split())]

    rows = words(1, ["a b c d", "e f g h"], ["a b c d", "x y"], ["a b c d"])  # the local words back the second pass
    rows += words(2, ["a b c d e f"], ["m n o p q"], ["x y z"])  # nothing in common: the middle pass stands
    rows += words(3, ["a b c"], ["a b c"], ["a b"])  # the vote kept enough
    d = spark.createDataFrame(rows, "key long, pass int, line long, seq long, token string, s long, e long")
    local = spark.createDataFrame([(1, "a b c d x y".split())], "key long, said array<string>")
    voted = al.vote(d, ["key"])
    got = {r.key: (r["pass"], r.by) for r in al.chosen_hearing(d, voted, ["key"], local).collect()}
    assert got == {1: (1, "support"), 2: (1, "middle"), 3: (None, "vote")}
    tie = spark.createDataFrame([(3, ["a", "b", "c"])], "key long, said array<string>")
    assert {r.key: r["pass"] for r in al.chosen_hearing(d, voted, ["key"], tie).collect()}[3] is None


def test_lists_are_converted_as_one_and_element_by_element(spark):
    for kind, rows in (("long", [[1, 2**60 + 1], None, [], [3]]), ("long", [[1, None], [2**60 + 1], None]), ("string", [["a"], [None, "b"], []]), ("double", [[0.5], None]), ("boolean", [[True]])):
        d = spark.createDataFrame([(1, i, x) for i, x in enumerate([[], *rows])], f"key long, id long, x array<{kind}>")
        got = al.each_clip(d, ["key"], ["id"], lambda clip: clip, f"id long, x array<{kind}>").collect()
        assert [r.x for r in sorted(got, key=lambda r: r.id)] == [[], *rows]


def test_clips_are_read_one_after_the_other(spark):
    # clips larger than a batch, small ones beside them; no frame for each
    d = spark.range(25_000).select(F.when(F.col("id") < 24_000, 0).otherwise(F.col("id")).alias("key"), "id")
    got = al.each_clip(d, ["key"], ["id"], lambda clip: [(len(clip), clip == sorted(clip))], "n long, sorted boolean").collect()
    assert sorted(r.n for r in got) == [1] * 1000 + [24_000] and all(r.sorted for r in got)
    w = spark.createDataFrame([(1, p, 0, k, "ab"[k], k, k + 1) for p in (0, 1) for k in (0, 1)], "key long, pass int, line long, seq long, token string, s long, e long")
    for q in (al.vote(w, ["key"]), al.witnesses(w, ["key"]), al.extra_lines(w, ["key"])):
        assert "InPandas" not in q._jdf.queryExecution().executedPlan().toString()


def test_matched_words_of_short_clips_cost_no_frames(spark, capsys):
    a = spark.createDataFrame([(1, 1, "a", 5), (1, 2, "b", 6), (2, 3, "a", None), (3, 4, "a", 1)], "key long, id long, token string, s long")
    b = spark.createDataFrame([(1, 11, "b", 6), (1, 12, "a", 9), (1, 13, "a", 4), (2, 14, "x", 1)], "key long, id long, token string, s long")
    got = tu.truth_pairs(a, b, ["key"])
    got.explain()
    assert "InPandas" not in capsys.readouterr().out
    assert sorted(tuple(x) for x in got.collect()) == [(1, 1, 13), (1, 2, 11)]


def test_cues_are_the_same_over_any_batches_and_sort_their_words_once(spark, capsys):
    r = random.Random(9)
    rows = [(k % 3 if k % 7 else None, k, r.choice("AB") if k % 40 > 20 else "A", s, s + 300_000, r.choice(["so", "well,", "long word", "end."])) for k, s in enumerate(range(0, 90_000_000, 450_000))]
    d = spark.createDataFrame(rows, "key long, id long, label string, s long, e long, text string")
    got = bu.build_cues(d, ["key"])
    got.explain()
    plan = capsys.readouterr().out
    assert "FlatMapGroups" not in plan and plan.count("Sort [") == 2  # words for their blocks, cues for their numbers
    want = sorted(map(str, got.collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(str, bu.build_cues(d, ["key"]).collect())) == want and len(want) > 10
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_short_stretches_cost_no_frames(spark, capsys):
    d = spark.createDataFrame([(1, 1, "A", "one two", 0, 800), (1, 2, None, "three", 90_000, 91_000), (2, 1, "A", "four", 0, 900)], "key long, number long, label string, text string, start_ms long, end_ms long")
    got = fi.fit_cues(d, ["key"])
    got.explain()
    assert "InPandas" not in capsys.readouterr().out
    assert sorted((x.key, x.number, x.text, x.joined) for x in got.collect()) == [(1, 1, "one two", 1), (1, 2, "three", 1), (2, 1, "four", 1)]
