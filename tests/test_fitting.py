import random
from itertools import combinations

import pytest

from cuelattice.operators import fitting as fi

R = fi.Limits()


def cue(n, label, text, start, end, read=0):
    return fi.Cue(n, label, text, start, end, read)


def _some(seed, n=40):
    r, at, cues = random.Random(seed), 0, []
    for k in range(n):
        at += r.choice([0, 0, 100, 700, 3000])
        end = at + r.choice([100, 300, 900, 2500, 5000])
        cues.append(cue(k, r.choice(["A", "B", None]), f"w{k} " + "x" * r.randrange(60), at, end, r.randrange(3000)))
        at = end if r.random() > 0.2 else at + 50
    return cues, sorted(r.randrange(at + 1) for _ in range(8))


@pytest.mark.parametrize("seed", range(60))
def test_promises_hold(seed):
    cues, cuts = _some(seed)
    got = fi.laid_out(cues, cuts, R)
    assert [n for c in got for n in c.numbers] == list(range(40))
    for a, b in zip(got, got[1:]):
        assert a.end + R.gap <= b.start
    for c in got:
        assert R.shortest <= c.end - c.start <= R.longest
        assert c.start >= c.first - R.lead and len(c.parts) <= R.voices
        assert len(c.numbers) == 1 or all(len(t) <= (R.one if len(c.parts) == 1 else R.line) for t in c.texts)


@pytest.mark.parametrize("seed", range(12))
def test_the_partition_is_the_cheapest(seed):
    cues, cuts = _some(seed, 9)
    line = fi.Line(cues, cuts, R)
    total = lambda runs: sum(line.price(*x) for x in runs)
    every = [[0, *c, 9] for k in range(9) for c in combinations(range(1, 9), k)]
    allowed = [list(zip(b, b[1:])) for b in every if all(line.parts(*x) is not None for x in zip(b, b[1:]))]
    assert abs(total(line.partition()) - min(map(total, allowed))) < 1e-9


def test_a_reply_shares_the_screen():
    got = fi.laid_out([cue(0, "A", "So you went there?", 0, 1500), cue(1, "B", "Right.", 1500, 1700), cue(2, "A", "And then " + "on " * 25, 1720, 6000)], [], R)
    assert [c.numbers for c in got] == [[0, 1], [2]] and got[0].texts == ["So you went there?", "Right."]


def test_short_cues_are_joined_where_a_join_is_allowed():
    # both are too short to be read; the picture changes behind the second, the third stands alone
    short = [cue(0, "A", "Yes.", 0, 300), cue(1, "A", "Of course.", 400, 800), cue(2, "A", "Later.", 9000, 9300)]
    assert [c.numbers for c in fi.laid_out(short, [], R)] == [[0, 1], [2]]
    far = [cue(0, "A", "Yes.", 0, 300), cue(1, "A", "Of course.", 2400, 2800)]
    assert [c.numbers for c in fi.laid_out(far, [], R)] == [[0], [1]]


def test_one_voice_is_one_part_and_cuts_part_unlabelled_ones():
    two = [cue(0, None, "one", 0, 300), cue(1, None, "two", 350, 500)]
    told = lambda cues, cuts=(): (p := fi.Line(cues, list(cuts), R).parts(0, 2)) and [[c.text for c in x] for x in p]
    assert told(two) == [["one", "two"]] and told(two, [320]) == [["one"], ["two"]]
    assert told([cue(0, "A", "x", 0, 300), cue(1, "A", "y" * 90, 350, 500)]) is None
    assert told([cue(0, "A", "x", 0, 300), cue(1, "B", "y", 6200, 6500)]) is None
    assert told([cue(0, "A", "x", 0, 300), cue(1, "B", "y" * 43, 350, 500)]) is None
    assert told([cue(0, "A", "x", 0, 300), cue(1, "B", "y", 1900, 2500)], [1000]) is None  # too long over a cut


def test_ways_to_find_room_in_their_order():
    long = "z" * 80  # too long to be shown with another voice
    # a little before its first word
    got = fi.laid_out([cue(0, "A", long, 1000, 1500), cue(1, "B", long, 1900, 5000)], [], R)
    assert (got[0].start, got[0].end, got[1].start) == (917, 1817, 1900)
    # past a cut of the picture
    got = fi.laid_out([cue(0, "A", long, 1000, 1500), cue(1, "B", long, 3000, 5000)], [1600], R)
    assert (got[0].start, got[0].end) == (1000, 1900)
    # the next one comes up late, but no more than late
    got = fi.laid_out([cue(0, "A", long, 1000, 1500), cue(1, "B", long, 1700, 5000)], [], R)
    assert (got[0].start, got[0].end, got[1].start) == (917, 1817, 1900)
    # held, and the next one waits
    got = fi.laid_out([cue(0, "A", long, 1000, 1100), cue(1, "B", long, 1200, 5000)], [], R)
    assert got[0].end - got[0].start == R.shortest and got[1].start == got[0].end + R.gap


def test_neighbours_trade_time_to_be_read():
    # what is said into the next one's time and can't be read gets what that one can spare
    got = fi.laid_out([cue(0, "A", "z" * 80, 0, 2000, 2500), cue(1, "B", "y" * 80, 1500, 6000, 2000)], [], R)
    assert got[0].end == 2000 and got[1].start == 2083
    # where neither can be read both are shown at one pace
    got = fi.laid_out([cue(0, "A", "z" * 80, 0, 4000, 4000), cue(1, "B", "y" * 80, 1500, 3600, 4000), cue(2, "B", "x" * 80, 4083, 9000)], [], R)
    assert abs((got[0].end - got[0].start) - (got[1].end - got[1].start)) <= 2 * R.gap
    # one voice alone does not wait for itself
    got = fi.laid_out([cue(0, "A", "z" * 80, 0, 2000, 2500), cue(1, "A", "y" * 80, 1500, 6000, 2000)], [], R)
    assert got[1].start == 1500


def test_a_cue_ends_before_a_cut_if_it_can(spark):
    d = spark.createDataFrame([(1, 0, "A", "hello", 0, 1000), (1, 1, "B", "far " * 15, 9000, 12000)], "key long, number long, label string, text string, start_ms long, end_ms long")
    cuts = spark.createDataFrame([(1, 1200)], "key long, at_ms long")
    plain = {r.number: r.end_ms for r in fi.fit_cues(d, ["key"]).collect()}
    cut = {r.number: r.end_ms for r in fi.fit_cues(d, ["key"], cuts).collect()}
    assert plain == {0: 1400, 1: 12400} and cut == {0: 1200, 1: 12400}


def test_stretches_give_what_the_whole_clip_gives(spark):
    for seed in (3, 4):
        r, at, cues = random.Random(seed), 0, []
        for k in range(120):  # crowds with rests between them
            at += r.choice([0, 20, 100, 100, 15_000])
            cues.append((1, k, r.choice("AB"), "t" * r.randrange(1, 70), at, at + r.choice([50, 300, 2000])))
        d = spark.createDataFrame(cues, "key long, number long, label string, text string, start_ms long, end_ms long")
        rows = fi.fit_cues(d, ["key"], rate=1000.0).collect()
        got = sorted((x.number, x.start_ms, x.end_ms, x.joined) for x in rows)
        whole = fi.laid_out([cue(n, v, t, s, e, 1 if t else 0) for _, n, v, t, s, e in cues], [], R)
        assert got == sorted((g.numbers[0], g.start, g.end, len(g.numbers)) for g in whole)
        assert fi.stretches(d, ["key"], R).agg({"stretch": "max"}).first()[0] > 1
        assert all(len(x.parts) <= 2 and sum(len(p) for p in x.parts) == x.joined for x in rows)


def test_ends_stop_at_cuts(spark):
    from cuelattice.operators import cues as cu

    d = spark.createDataFrame([(1, 0, "t" * 60, 0, 1000), (1, 1, "t" * 60, 9000, 9500)], "key long, number long, text string, start_ms long, end_ms long")
    cuts = spark.createDataFrame([(1, 1000), (1, 1700), (2, 9600)], "key long, at_ms long")
    ends = lambda c: [r.new_end_ms for r in cu.readable_ends(d, ["key"], 17.0, 6000, 83, cuts=c).orderBy("number").collect()]
    assert ends(None) == [3000, 11500] and ends(cuts) == [1700, 11500]
