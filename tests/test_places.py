import random

import pytest
from pyspark.sql import functions as F

from cuelattice.functions import spelling, text
from cuelattice.operators import places as pl
from cuelattice.operators import truth as tu
from cuelattice.plans.hearing import QUERIES

S = 1_000_000


def test_numbers_as_they_are_spoken(spark):
    want = {0: "zero", 7: "seven", 21: "twenty-one", 100: "one hundred", 999: "nine hundred and ninety-nine", 1000: "one thousand", 1001: "one thousand and one", 12_345: "twelve thousand, three hundred and forty-five", 1_000_010: "one million and ten"}
    d = spark.createDataFrame([(n,) for n in want], "n long")
    assert {r.n: r.t for r in d.select("n", spelling.english(F.col("n")).alias("t")).collect()} == want
    one = spark.createDataFrame([("4,000 men, 12 of 3.500 and 99999999999999999999",)], "t string").select(spelling.said(F.col("t"))).first()[0]
    assert one == "four thousand men, twelve of three thousand, five hundred and 99999999999999999999"
    d = spark.createDataFrame([(["about", "4", "000", "000.", "and", "7", "50"],)], "w array<string>").select(spelling.joined(F.col("w"))).first()[0]
    assert d == ["about", "4000000.", "", "", "and", "7", "50"]


def test_words_held_by_the_piece_before(spark):
    lines = [(1, 0, 2 * S, S, 4 * S, "one two three four five six"), (1, 1, 2 * S, 5 * S, 6 * S, "after the cut"), (1, 2, 2 * S, S, 3 * S, "held whole"), (1, 3, 2 * S, 0, S, "before it")]
    d = spark.createDataFrame(lines, "key long, line long, lead long, s long, e long, text string")
    before = spark.createDataFrame([(1, 0, 3 * S, "zero one two three"), (1, 1, 3 * S, "held whole")], "key long, other long, e long, text string")
    got = {r.line: (r.s, r.e, r.text) for r in pl.owned_lines(d, before, ["key"]).collect()}
    # three of six words are gone: the line starts in its middle, half a second behind the cut
    assert got == {0: (S // 2, 2 * S, "four five six"), 1: (3 * S, 4 * S, "after the cut")}


def test_what_a_line_before_holds(spark):
    def held(mine, other, end=9):
        a = spark.createDataFrame([(1, 0, 5, mine.split())], "key long, line long, s long, t array<string>")
        b = spark.createDataFrame([(1, 0, end, other.split())], "key long, other long, e long, t array<string>")
        return [r.held for r in pl.held_words(a, b, ["key"]).collect()]

    assert held("a b c d e", "x y a b c") == [3]
    assert held("a b c d e", "x a c") == [3] and held("a c d e", "x a b c") == [2]  # a word is missing on one side
    assert held("a b c d e", "a b c x y z") == []  # it goes on elsewhere
    assert held("a b", "x a b y y y y") == [2]  # the whole line
    assert held("a b c d e", "x y a b c q") == [3] and held("a b c", "x y", 9) == []
    assert held("a b c", "a b c", 5) == []  # it ended before the line began


@pytest.mark.parametrize("seed", range(40))
def test_first_words_held_are_those_of_all_offsets(seed):
    r = random.Random(seed)
    a, b = (["abcd"[r.randrange(4)] for _ in range(r.randrange(9))] for _ in range(2))
    same, last = {}, {}
    for i, j in ((i, j) for i in range(len(a)) for j in range(len(b)) if a[i] == b[j]):
        for k in (j - i - 1, j - i, j - i + 1):
            same.setdefault(k, set()).add(i)
            last[k] = max(last.get(k, 0), j)
    good = [max(x) + 1 for k, x in same.items() if (max(x) + 1 == len(a) or last[k] + 2 >= len(b)) and len(x) >= 0.6 * (max(x) + 1)]
    assert pl.first_held(a, b, 0.6, 1) == max(good, default=0)


def test_lines_meet_as_rows_of_their_own(spark, capsys):
    """No row for each word, which a large table shuffles by the hundred millions."""
    a = spark.createDataFrame([(1, 0, 5, ["a"])], "key long, line long, s long, t array<string>")
    b = spark.createDataFrame([(1, 0, 9, ["a"])], "key long, other long, e long, t array<string>")
    pl.held_words(a, b, ["key"]).explain()
    assert "Generate" not in capsys.readouterr().out


def test_copies_are_those_of_all_pairs(spark, capsys):
    r = random.Random(4)
    pieces = [(k % 2, k, "ab"[k % 3 % 2], s, s + r.randrange(1, 40) * S, " ".join(r.choice("vwxyz") for _ in range(r.randrange(6)))) for k, s in enumerate(r.randrange(200) * S for _ in range(40))]
    words = [(k % 2, 900 - k, "ab"[k % 5 % 2], r.randrange(220) * S, r.choice("vwxyz")) for k in range(120)]
    d = spark.createDataFrame(pieces, "key long, id long, label string, s long, e long, text string")
    w = spark.createDataFrame(words, "key long, id long, label string, s long, token string")
    got = pl.copies(d, w, ["key"], 8 * S)
    # words stand in one stretch of time each, and are not copied to buckets
    got.explain()
    dealt = [x for x in capsys.readouterr().out.splitlines() if "AS __bucket" in x]
    assert len(dealt) == 2 and not any("token" in x for x in dealt)

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *(was := row)[1:]]
            for j, y in enumerate(b):
                row[j + 1] = max(was[j] + (x == y), was[j + 1], row[j])
        return row[-1]

    want = set()
    for key, i, label, s, e, t in pieces:
        said = [x[4] for x in sorted(words, key=lambda x: (x[3], x[1])) if (x[0], x[2]) == (key, label) and s - 8 * S <= x[3] <= e + 8 * S]
        if t.split() and common(t.split(), said) >= 0.6 * len(t.split()):
            want.add(i)
    assert {x.id for x in got.collect()} == want and 5 < len(want) < 35


def test_cuts_go_where_voices_part(spark):
    # three words of one voice, two of another; the widest pause is elsewhere
    rows = [(1, k * S, k * S + w, lean) for k, (w, lean) in enumerate([(600_000, 0.5), (400_000, 0.4), (600_000, 0.6), (700_000, -0.5), (700_000, -0.4)])]
    words = spark.createDataFrame(rows, "key long, s long, e long, lean double")
    cuts = spark.createDataFrame([(1, 9, 0, 5 * S), (1, 8, 50 * S, 60 * S)], "key long, id long, s long, e long")
    got = {r.id: r["at"] for r in pl.cut_places(cuts, words, ["key"]).collect()}
    assert got == {9: (2 * S + 600_000 + 3 * S) // 2, 8: None}


def test_copies_in_order(spark):
    pieces = spark.createDataFrame([(1, 0, "A", 0, S, "one two three four five"), (1, 1, "A", 0, S, "five four three two one"), (1, 2, "B", 0, S, "one two three four five")], "key long, id long, label string, s long, e long, text string")
    words = spark.createDataFrame([(1, i, "A", 2 * S + i, t) for i, t in enumerate("one x two three".split())], "key long, id long, label string, s long, token string")
    assert [r.id for r in pl.copies(pieces, words, ["key"]).collect()] == [0]


def test_piles_are_spread(spark):
    rows = [(1, i, 10 * S, 10 * S + i * 10_000, "ab") for i in range(6)] + [(1, 9, 20 * S, 21 * S, "alone")]
    d = spark.createDataFrame(rows, "key long, id long, s long, e long, text string")
    got = {r.id: (r.s, r.e) for r in pl.unpiled(d, ["key"]).collect()}
    assert got[9] == (20 * S, 21 * S) and got[0][0] == 10 * S and got[5][1] == 10 * S + 50_000
    assert all(got[i][1] == got[i + 1][0] for i in range(5))


def test_repeated_words_of_a_cue(spark):
    words = spark.createDataFrame([(1, i, t, i * S) for i, t in enumerate("a b c d".split())], "key long, id long, token string, s long")
    shown = spark.createDataFrame([(1, 0, i, t, 0, 4 * S) for i, t in enumerate("a b c d".split())] + [(1, 1, 10, "b", 5 * S, 6 * S), (1, 1, 11, "c", 5 * S, 6 * S), (1, 2, 12, "d", 5 * S, 6 * S), (1, 3, 13, "c", 90 * S, 91 * S)], "key long, cue long, id long, token string, s long, e long")
    used = spark.createDataFrame([(1, i) for i in range(4)], "key long, id long")
    assert sorted(r.id for r in tu.duplicated(words, shown, used, ["key"]).collect()) == [10, 11, 12]


def _shown_again(words, shown, used, near):
    """The rule as it is told, pair by pair."""
    found = set()
    for key, cue, at, token, s, e in shown:
        tokens = [w[2] for w in sorted((w for w in words if w[0] == key), key=lambda w: (w[3], w[1]))]
        times = sorted(w[3] for w in words if w[0] == key)
        near_by = [i for i, t in enumerate(times) if s - near <= t <= e + near]
        mine = [w[3] for w in sorted((w for w in shown if w[:2] == (key, cue)), key=lambda w: w[2])]
        j = sorted(w[2] for w in shown if w[:2] == (key, cue)).index(at)
        pairs = set(zip(mine[max(j - 1, 0) : j + 1], mine[max(j - 1, 0) + 1 : j + 1], strict=False)) | set(zip(mine[j : j + 1], mine[j + 1 : j + 2], strict=False))
        said = {(tokens[i - 1], tokens[i]) for i in near_by if i} if pairs else {tokens[i] for i in near_by}
        if (key, at) not in used and (pairs or {token}) & said:
            found.add((key, at))
    return found


def test_words_shown_twice_as_lists_and_one_by_one(spark):
    rnd = random.Random(3)
    words = [(rnd.randint(1, 3), i, rnd.choice("abc"), rnd.randrange(3000)) for i in range(90)]
    shown = []
    for cue in range(40):
        key, s = rnd.randint(1, 3), rnd.randrange(3000)
        shown += [(key, cue, 10 * cue + i, rnd.choice("abc"), s, s + 40) for i in range(rnd.randint(1, 4))]
    used = {(w[0], w[2]) for w in shown if rnd.random() < 0.3}
    want = _shown_again(words, shown, used, 30)
    assert 0 < len(want) < len(shown) - len(used)
    w = spark.createDataFrame(words, "key long, id long, token string, s long")
    c = spark.createDataFrame(shown, "key long, cue long, id long, token string, s long, e long")
    u = spark.createDataFrame(sorted(used), "key long, id long")
    assert {(r.key, r.id) for r in tu.duplicated(w, c, u, ["key"], 30).collect()} == want
    # lists of any length, in which a cue stands in two rows, and some without words
    ordered = lambda *cs: F.sort_array(F.collect_list(F.struct(*cs)))
    at = lambda name: F.transform("l", lambda x: x[name])
    lines = w.groupBy("key", F.col("id") % 7).agg(ordered("s", "id", "token").alias("l")).select("key", at("id").alias("ids"), at("token").alias("tokens"), at("s").alias("times"))
    lines = lines.unionByName(spark.createDataFrame([(1, None, None, None), (2, [], [], [])], "key long, ids array<long>, tokens array<string>, times array<long>"))
    cues = c.groupBy("key", "cue", "s", "e", F.col("id") % 2).agg(ordered("id", "token").alias("l")).select("key", "cue", "s", "e", at("id").alias("ids"), at("token").alias("tokens"))
    got = tu.duplicated_in(lines, cues, u.groupBy("key").agg(F.collect_list("id").alias("ids")), ["key"], 30)
    assert {(r.key, r.id) for r in got.collect()} == want


def test_words_shown_twice_are_not_shuffled_one_by_one(spark):
    plan = QUERIES["duplicated_words"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # a line of words is a row: none stands in buckets, and none is joined
    assert "__bucket" not in plan and "Join" not in plan and plan.count("Exchange hashpartitioning") <= 5


def test_turns_of_one_number_or_none_are_shown_each_by_itself(spark, tmp_path):
    said = [(1, 0, "one two three"), (1, 1, "four five"), (1, 1, "four five"), (1, 2, "Six!"), (2, 0, "a b"), (2, 1, None), (2, 2, "..."), (3, None, "c d e")]
    spark.createDataFrame([(k, n, "user", x) for k, n, x in said], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert {r.key: r.twice for r in QUERIES["duplicated_words"](spark, str(tmp_path)).collect()} == {1: 8, 2: 2, 3: 3}


def test_fills_said_already(spark):
    fills = spark.createDataFrame([(1, 0, 0, S, "said it here"), (1, 1, 0, S, "quite new words")], "key long, line long, s long, e long, text string")
    lines = spark.createDataFrame([(1, 0, S, 2 * S, "he said it here now")], "key long, line long, s long, e long, text string")
    assert [r.line for r in pl.new_fills(fills, lines, ["key"]).collect()] == [1]


def test_pieces_are_joined(spark):
    lines = spark.createDataFrame([(1, 0, 0, 5, 9), (1, 1, 0, 1, 2)], "key long, piece long, line long, s long, e long")
    pieces = spark.createDataFrame([(1, 0, 0, 100), (1, 1, 100, 200)], "key long, piece long, s long, e long")
    assert sorted((r.number, r.s, r.e) for r in pl.joined_pieces(lines, pieces, ["key"]).collect()) == [(1, 5, 9), (2, 101, 102)]
    d = spark.createDataFrame([("a b c",)], "t string")
    assert len(d.select(text.gram_hashes(text.tokens(F.col("t")), 2)).first()[0]) == 2 and d.select(text.gram_hashes(text.tokens(F.col("t")), 9)).first()[0] == []


def test_lines_take_the_times_of_what_was_heard(spark):
    # the line's words stand ten seconds late; two of three were heard in it
    words = spark.createDataFrame([(1, 0, 0, "before", 0, S), (1, 1, 1, "one", 14 * S, 15 * S), (1, 1, 2, "two", 15 * S, 16 * S), (1, 1, 3, "three", 16 * S, 17 * S), (1, 2, 4, "after", 20 * S, 21 * S)], "key long, line long, id long, token string, s long, e long")
    lines = spark.createDataFrame([(1, 0, 0, S), (1, 1, 4 * S, 8 * S), (1, 2, 20 * S, 21 * S)], "key long, line long, s long, e long")
    heard = spark.createDataFrame([(1, 0, "one", 4 * S, 5 * S), (1, 1, "three", 7 * S, 8 * S)], "key long, id long, token string, s long, e long")
    got = {r.token: (r.s, r.e, r.source) for r in pl.retimed(words, lines, heard, ["key"]).collect()}
    assert got["one"] == (4 * S, 5 * S, "heard") and got["two"] == (5 * S, 7 * S, "unplaced") and got["three"] == (7 * S, 8 * S, "heard")
    assert got["before"][2] == got["after"][2] == "aligned"
    # one heard word of three is too few
    few = {r.token: r.source for r in pl.retimed(words, lines, heard.limit(1), ["key"]).collect()}
    assert set(few.values()) == {"aligned"}


def test_minutes_written_without_a_colon(spark):
    def back(*passes, length=95):
        rows = [(1, p, k, int(a * S), int(b * S), t, length * S) for p, run in enumerate(passes) for k, (a, b, t) in enumerate(run)]
        d = spark.createDataFrame(rows, "key long, pass long, line long, s long, e long, text string, length long")
        got = pl.read_back_passes(d, ["key"]).orderBy("pass", "line").collect()
        return [(r.s / S, r.e / S) for r in got], {r["pass"]: r.back for r in got}

    # 1:05 came as 105: past the end of the request, so all of the pass is read back
    times, said = back([(10, 12, "early"), (58, 103, "over the minute"), (105, 120, "behind it")])
    assert times == [(10, 12), (58, 63), (65, 80)] and said == {0: True}
    # a time between 60 and 100 s can't be written so
    assert back([(10, 12, "a"), (70, 75, "b"), (105, 110, "c")])[1] == {0: False}
    # a long request: the line over the minute is as long as its letters take only when it is read back
    assert back([(58, 104, "seven words that take a few seconds to say"), (110, 112, "b")], length=200)[1] == {0: True}
    assert back([(58, 104, "x" * 640), (110, 112, "b")], length=200)[1] == {0: False}
    # without such a line another pass decides, that heard speech where this one has none
    assert back([(10, 12, "a"), (105, 110, "b")], [(10, 12, "a"), (65, 70, "b")], length=200)[1] == {0: True, 1: False}
    assert back([(10, 12, "a"), (105, 110, "b")], length=200)[1] == {0: False}


def test_lines_past_their_piece(spark):
    rows = [
        (1, 0, 10, 12, "the first line here", 90), (1, 1, 105, 107, "slipped by its colon", 90), (1, 2, 70, 103, "its end slipped", 90), (1, 3, 300, 301, "quite new words", 90), (1, 4, 400, 402, "the first line", 90),
        (2, 0, 5, 80, "long", 60), (2, 1, -3, -2, "too early", 60), (3, 0, 50, 51, "a", 90), (3, 1, 105, 106, "lands on the next", 90), (3, 2, 60, 66, "b", 90), (3, 3, 110, 112, "in order one", 90), (3, 4, 108, 109, "out of order two", 90),
    ]
    d = spark.createDataFrame([(k, n, a * S, b * S, t, length * S) for k, n, a, b, t, length in rows], "key long, line long, s long, e long, text string, length long")
    got = {(r.key, r.line): (r.verdict, *(x if x is None else x / S for x in (r.s, r.e))) for r in pl.placed_lines(d, ["key"]).collect()}
    assert got[1, 0] == ("inside", 10, 12) and got[1, 1] == ("slipped", 65, 67) and got[1, 2] == ("inside", 70, 91)
    assert got[1, 3] == ("edge", 90.7, 91) and got[1, 4] == ("invented", None, None)
    assert got[2, 0] == ("inside", 5, 61) and got[2, 1] == ("inside", -1, -1)
    assert got[3, 1][0] == "edge" and got[3, 3] == ("slipped", 70, 72) and got[3, 4][0] == "edge"
    assert len(got) == len(rows) and pl.placed_lines(d.limit(0), ["key"]).count() == 0


def test_bands_at_one_place_need_no_grid(spark):
    rows = [(1, t * S, top, top + 0.05) for t, top in enumerate([0.1029, 0.1031, 0.1069, 0.5, 0.5])] + [(1, 0, 0.8, 0.9), (1, 5 * S, 0.8, 0.97)]
    d = spark.createDataFrame(rows, "key long, at long, top double, bottom double")
    got = sorted((round(r.top, 4), round(r.bottom, 4), r["first"] // S, r["last"] // S) for r in pl.steady_bands(d, ["key"]).collect())
    assert got == [(0.1029, 0.1569, 0, 2), (0.5, 0.55, 3, 4)]


def test_a_moment_inside_the_sound_is_speech(spark):
    gaps = spark.createDataFrame([(1, 1, 5, 5), (1, 2, 0, 10), (1, 3, 50, 50)], "key long, id long, s long, e long")
    tiers = spark.createDataFrame([(1, 0, 8, 0), (1, 8, 10, 2)], "key long, s long, e long, tier int")
    got = {r.id: (r.silent_us, r.open_us, r.verdict) for r in pl.judged_by_sound(gaps, tiers, ["key"], 10).collect()}
    assert got == {1: (0, 0, "speech"), 2: (8, 2, "silence"), 3: (None, None, "unchecked")}
