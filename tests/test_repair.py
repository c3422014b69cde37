import numpy as np
from pyspark.sql import functions as F

from cuelattice.functions.languages import LANGUAGES, with_language
from cuelattice.operators import evidence as ev
from cuelattice.operators import repair as rp

LINES = "key long, line long, s long, e long, text string"
S = 1_000_000


def test_punctuation_takes_the_times_of_its_letters(spark):
    texts = spark.createDataFrame([(1, "Well, it's -- fine!")], "key long, text string")
    pieces = spark.createDataFrame([(1, 0, 0, 10, "well"), (1, 1, 10, 20, "it"), (1, 2, 20, 30, "s fi"), (1, 3, 30, 40, "ne")], "key long, id long, s long, e long, text string")
    got = sorted((r.at, r.text, r.s, r.e) for r in rp.attach_punctuation(texts, pieces, ["key"]).collect())
    assert got == [(0, "Well,", 0, 10), (1, "it's", 10, 30), (2, "--", 20, 30), (3, "fine!", 20, 40)]


def test_a_dropped_line_takes_its_copy_s_times(spark):
    rows = [(1, 0, 0, S, "A", "Hello there", True), (1, 1, 3 * S, 4 * S, "A", "hello there!", False), (1, 2, 30 * S, 31 * S, "A", "hello there", False), (1, 3, 5 * S, 6 * S, "B", "other", True)]
    d = spark.createDataFrame(rows, "key long, id long, s long, e long, label string, text string, dropped boolean")
    got = sorted((r.id, r.s, r.e) for r in rp.hand_over_copies(d, ["key"]).collect())
    assert got == [(0, 3 * S, 4 * S), (2, 30 * S, 31 * S)]


def test_echoes(spark):
    lines = spark.createDataFrame([(1, 0, 10 * S, 11 * S, "Wonderfully"), (1, 1, 10 * S, 11 * S, "Nope"), (1, 2, 60 * S, 61 * S, "wonderful"), (1, 3, 10 * S, 11 * S, "one two wonderful")], LINES)
    words = spark.createDataFrame([(1, 8 * S, 9 * S, "wonderful")], "key long, s long, e long, token string")
    assert [r.line for r in rp.echoes(lines, words, ["key"]).collect()] == [0]


def test_faults_are_seeded(spark):
    d = spark.range(2000).select(F.lit(1).alias("key"), "id", (F.col("id") * S).alias("s"), (F.col("id") * S + 900_000).alias("e"), F.lit("A").alias("label"), F.lit("w").alias("text"))
    for kind in ("late", "relabelled", "instant", "doubled", "dropped"):
        a, b = (rp.inject(d, ["key"], kind, 0.1, seed=7) for _ in range(2))
        assert a.exceptAll(b).count() == 0
        n = 2000 - a.count() if kind == "dropped" else a.where("fault").select("id").distinct().count()
        assert 150 <= n <= 250
    cells = rp.bench_cells(spark.createDataFrame([("a",), ("b",)], "clip string"), spark.createDataFrame([("none",), ("late",)], "fault string"), spark.createDataFrame([(True,)], "local boolean"), 3)
    assert cells.count() == 2 * (1 + 3)


def test_seams(spark):
    r = np.random.default_rng(1)
    v = np.repeat(np.eye(4)[[0, 1]], [8, 9], axis=0) + r.normal(size=(17, 4)) * 0.05
    d = spark.createDataFrame([(1, i, i, x.tolist()) for i, x in enumerate(v)], "key long, id long, s long, vec array<double>")
    assert [x.id for x in rp.seams(d, ["key"], 0.6).collect()] == [8]


def test_unknown_languages_take_the_usual_values(spark):
    d = spark.createDataFrame([("ja",), ("xx",), (None,)], "lang string")
    got = {r.lang: (r.name, r.line_chars, r.spaced) for r in with_language(d, "lang").collect()}
    assert got == {"ja": ("Japanese", 13, False), "xx": ("xx", 42, True), None: (None, 42, True)}
    assert len({c for c, *_ in LANGUAGES}) == 34


def test_budget_and_densest(spark):
    d = spark.createDataFrame([(1, i, c) for i, c in enumerate([50, 30, 5, 30, 5, 5])], "key long, id long, cost long")
    got = {r.id: r.allowed for r in ev.within_budget(d, ["key"], 3, "cost", 60).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: True, 5: False}
    lines = spark.createDataFrame([(1, 0, 0, 5, 3), (1, 1, 6, 9, 9), (1, 2, 30, 31, 1), (1, 3, 60, 100, 50)], "key long, id long, s long, e long, words long")
    best = ev.densest(lines, ["key"], 20, 1).collect()
    assert [(r.s, r.e, r.words) for r in best] == [(0, 9, 12)]


def test_bands_lift_the_line(spark):
    d = spark.createDataFrame([([(0.85, 0.95), (0.2, 0.3)],), ([(0.2, 0.3)],), ([],)], "b array<struct<top: double, bottom: double>>")
    assert [r[0] for r in d.select(ev.clear_bottom(F.col("b"), 1000, 50, 100, 10)).collect()] == [160, 50, 50]
