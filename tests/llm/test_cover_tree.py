import numpy as np
import pytest

from cuelattice.llm.cover_tree import CoverTree, close_vectors, dual, unit

VECS = "vec_id long, embedding array<float>, label int"


def _data(seed, n, dim=8):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dim))
    x = centres[r.integers(0, 6, n)] + r.normal(size=(n, dim)) * r.choice([0.02, 0.1, 0.6], (n, 1))
    x[1::9] = x[0::9][: len(x[1::9])]  # equal vectors
    x[2::9] = 2.5 * x[0::9][: len(x[2::9])]  # equal directions
    return x.astype(np.float32)


def _brute(rows, cosine=0.98):
    ids = [i for i, _, _ in rows]
    good = [v is not None and label is not None and len(v) and all(a is not None and np.isfinite(a) for a in v) and any(v) for _, v, label in rows]
    near = np.zeros((len(rows), len(rows)), bool)
    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(a) == len(b):
                a, b = np.array(a, float), np.array(b, float)
                near[i, j] = near[j, i] = a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine
    part = np.arange(len(rows))
    for _ in range(len(rows)):
        new = np.array([min(part[k] for k in [i, *np.flatnonzero(near[i])]) for i in range(len(rows))])
        if (new == part).all():
            break
        part = new
    least = {p: min(ids[i] for i in np.flatnonzero(part == p)) for p in set(part)}
    return {ids[i]: (int(near[i].sum()), least[part[i]]) for i in range(len(rows))}


@pytest.mark.parametrize("leaf", [6, 40, 5000])
def test_equals_brute_force(spark, leaf):
    x = _data(leaf, 260)
    rows = [(i, v.tolist(), int(i % 5 == 0)) for i, v in enumerate(x)]
    rows += [(1000, None, 0), (1001, [0.0] * 8, 0), (1002, [float("nan")] + [1.0] * 7, 0), (1003, [None] + [1.0] * 7, 0), (1004, x[0].tolist(), None), (1005, [], 0), (1006, x[0].tolist()[:4], 0), (1007, [float("inf")] + [1.0] * 7, 0)]
    got = close_vectors(spark.createDataFrame(rows, VECS), leaf=leaf).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == _brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_centres_that_are_not_sent_around(spark, monkeypatch):
    # parts of a node meet its centres once each; the links are the same
    monkeypatch.setattr("cuelattice.llm.cover_tree.BROADCAST_BYTES", 0)
    monkeypatch.setattr("cuelattice.llm.cover_tree.PART", 16)
    rows = [(i, v.tolist(), int(i % 5 == 0)) for i, v in enumerate(_data(2, 260))]
    got = close_vectors(spark.createDataFrame(rows, VECS), leaf=20).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == _brute(rows)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    from pyspark.sql import functions as F

    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (None, [0.0, 1.0], 0)]
    d = spark.createDataFrame(rows, VECS).withColumn("node", F.lit("clash")).withColumn("n_links", F.lit("clash"))
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in close_vectors(d).collect())
    assert got == [("1", 2, "1", True), ("1", 2, "1", True), ("None", 0, "None", False), ("None", 2, "1", False)]
    assert close_vectors(spark.createDataFrame([], VECS)).count() == 0


def test_traversal_prunes_and_loses_nothing():
    # groups far apart: most rows are never compared
    r = np.random.default_rng(3)
    x, y = (unit(np.repeat(np.eye(12)[part], 20, axis=0) + r.normal(size=(120, 12)) * 0.01) for part in (slice(0, 6), slice(5, 11)))
    rows, columns, close = dual(CoverTree(x), CoverTree(y), 0.98)
    assert close.sum() == (x @ y.T >= 0.98).sum() > 0
    assert len(rows) < len(x) / 2 and len(columns) < len(y) / 2
    for parents, centres, reach in CoverTree(x).levels[1:-1]:
        assert len(parents) == len(centres) == len(reach)
