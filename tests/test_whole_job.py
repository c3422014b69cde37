"""Queries and operators do their whole job: no row, text or part of it is left out."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from cuelattice.operators import alignment as al
from cuelattice.operators import build as bu
from cuelattice.operators import evidence as ev
from cuelattice.plans import catalogue

QUERIES = catalogue.queries()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of tables whose texts and ids lie beyond any short prefix or small range."""
    at = str(tmp_path_factory.mktemp("tables"))
    long = " ".join(f"w{i}" for i in range(250))
    other = " ".join(f"w{i}" for i in range(240)) + " " + " ".join(f"x{i}" for i in range(10))
    many = " ".join(f"w{i}" for i in range(40))
    docs = [(5000, many + " one tail of it\n" + many.upper().replace("W", "v") + " x"), (7, many + " q" * 40 + "\n" + many + " z" * 40)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    turns = [(4, 1, "user", long), (4, 2, "bot", other)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{at}/conversations.parquet")
    events = [(e, 1, "view", 1.0) for e in (1, 80, 82, 84, 86)]
    d = spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double")
    d.withColumn("ts", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'")).write.parquet(f"{at}/events.parquet")
    return at


def test_similar_lines_of_all_documents_and_whole_lines(spark, tables):
    got = {(r.key, r.line, r.b_line): r.alike for r in QUERIES["similar_lines"](spark, tables).collect()}
    # lines are alike with themselves only: behind 40 equal words they differ
    assert sorted(got) == [(7, 1, 1), (7, 2, 2), (5000, 1, 1), (5000, 2, 2)]
    assert got[7, 1, 1] == round(160 / 161, 6)


def test_similar_lines_meet_without_their_texts(spark, tables, capsys):
    """A line stands in several buckets of time: only its size does."""
    QUERIES["similar_lines"](spark, tables).explain()
    plan = capsys.readouterr().out
    dealt = [x for x in plan.splitlines() if "AS __bucket" in x]
    assert len(dealt) == 2 and not any(" t#" in x or "b_t#" in x or "text#" in x for x in dealt)
    assert plan.count("alike(") == 1


@pytest.mark.parametrize("forgets", (False, True))
@pytest.mark.parametrize("seed", range(30))
def test_lines_said_near_in_time_are_those_of_all_pairs(seed, forgets):
    r = random.Random(seed)
    lines = sorted((s, k, s + r.choice((0, 3, 3, 40)), [r.choice("abcd") for _ in range(r.randrange(6))]) for k, s in enumerate(r.randrange(150) for _ in range(60)))
    said, got = ev._Said(4), {}
    for s, k, e, words in lines:
        if forgets:
            said.most = (0, 0)
        got |= {x[0]: x[2:] for x in said.done(s)}
        said.add(k, s, e, words)
    got |= {x[0]: x[2:] for x in said.done(None)}
    grams = lambda t: {*zip(t, t[1:], strict=False)}
    for s, k, e, t in lines:
        mine = grams(t) or set(t)
        near = [{*grams(u), *u} for s2, j, e2, u in lines if j != k and s2 - 4 <= e and s <= e2 + 4]
        assert got[k] == [sum(any(g in u for u in near) for g in mine), len(mine)]


def test_lines_said_before_are_not_dealt_by_the_word(spark, tables, capsys):
    d = spark.createDataFrame([(1, 1, 0, 5, "a b c"), (1, 2, 6, 7, "b c"), (1, 3, 90, 91, "b c"), (1, 4, 7, 8, "c"), (1, 5, 0, 1, None), (2, 1, None, 9, "b c")], "key long, line long, s long, e long, text string")
    got = ev.said_before(d, ["key"], 3)
    got.explain()
    assert "Generate" not in capsys.readouterr().out
    assert {(x.key, x.line): x.old for x in got.collect()} == {(1, 1): False, (1, 2): True, (1, 3): False, (1, 4): True, (1, 5): False, (2, 1): False}


@pytest.mark.parametrize("seed", range(60))
def test_ratio_equals_its_definition(seed):
    r = random.Random(seed)
    x = [r.choice("abcd") for _ in range(r.randrange(40))]
    y = r.choice([[*x, "end"], [c if r.random() > 0.15 else r.choice("abcd") for c in x], [r.choice("abcd") for _ in range(r.randrange(40))]])
    want = round(SequenceMatcher(None, x, y, autojunk=False).ratio(), 6)
    assert ev.ratio(x, y) == want
    assert ev.ratio(x, y, 0.8) == (want if want >= 0.8 else None)


def test_edit_path_of_whole_turns(spark, tables):
    (got,) = QUERIES["edit_path"](spark, tables).collect()
    assert (got.said, got.wrong) == (250, 10)


@pytest.mark.parametrize("seed", range(20))
def test_edit_steps_are_the_same_from_kept_rows(seed):
    r = random.Random(seed)
    a, b = (["abcd"[r.randrange(4)] for _ in range(r.randrange(40))] for _ in range(2))
    assert al.edit_steps(a, b, 0) == al.edit_steps(a, b)


def test_no_cue_is_too_long(spark):
    # one speaker, no sentence ends: more than 256 cues; and pauses by which each cut takes a word off the edge
    plain = [(1, i, f"word{i:06}", i * 500_000, i * 500_000 + 400_000, "A") for i in range(4000)]
    pauses = [(2, i, f"w{i}", i * 1_000_000 + i * i * 1000, i * 1_000_000 + i * i * 1000 + 100_000, "A") for i in range(35)]
    d = spark.createDataFrame(plain + pauses, "key long, id long, text string, s long, e long, label string")
    got = bu.build_cues(d, ["key"]).orderBy("key", "number").collect()
    assert all(len(c.text) <= 84 and c.end_ms - c.start_ms <= 6000 for c in got)
    assert [" ".join(c.text for c in got if c.key == k).split() for k in (1, 2)] == [[w[2] for w in x] for x in (plain, pauses)]


def test_placement_clears_all_bands(spark, tables):
    # tops 0.01, 0.80, 0.82, 0.84 and 0.86, each 0.06 high: the lowest lift it to 171, 193, 214 and 236
    assert [r.margin for r in QUERIES["placement"](spark, tables).collect()] == [236]


def test_settings_are_tried_in_their_own_row(spark):
    from cuelattice.operators import rules as ru

    # equal rows all stay, and none becomes many
    d = spark.createDataFrame([(1, 2.0, 2.0, 0.6)] * 2 + [(2, 2.0, 1.0, 0.1)], "key long, min_duration double, min_readable double, min_gap double")
    got = ru.nearest_holding(d, "min_gap", 0.0, 0.6, 0.05, ["gaps", "readable"])
    assert sorted((r.key, r.min_gap, r.nearest) for r in got.collect()) == [(1, 0.6, 0.5), (1, 0.6, 0.5), (2, 0.1, None)]
    assert not {"Exchange", "Generate"} & set(got._jdf.queryExecution().executedPlan().toString().split())
