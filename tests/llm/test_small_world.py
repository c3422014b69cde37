"""Neighbours found by small-world graphs against brute force, the graph's form, and edge cases."""

import math

import numpy as np

from cuelattice.llm import queries as q
from cuelattice.llm.common import table
from cuelattice.llm.small_world import FAN, HIGH, LOW, Graph, lengthened, nearest

VECTORS = "vec_id long, embedding array<float>, label int"


def _sound(v):
    return v and all(x is not None and math.isfinite(x) for x in v) and any(v)


def _brute(rows, k=20, every=20):
    """{query_id: [(vec_id, score)]} over distinct sound rows."""
    known = sorted({(i, tuple(map(float, np.float32(v)))) for i, v, *_ in rows if i is not None and _sound(v)})
    out = {}
    for i, v in known:
        if i % every == 0:
            near = sorted((-float((np.array(v) * np.array(w)).sum()), j) for j, w in known if j != i and len(w) == len(v))
            out.setdefault(i, []).extend((j, -s) for s, j in near[:k])
    return out


def _got(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def _same(got, want):
    assert got.keys() == {k for k, v in want.items() if v}
    for i, found in got.items():
        assert [j for j, _ in found] == [j for j, _ in want[i]]
        assert np.allclose([s for _, s in found], [s for _, s in want[i]], rtol=1e-12)


def _recall(got, want):
    hit = n = 0
    for i, near in want.items():
        least = near[-1][1] - 1e-12
        hit += sum(s >= least for _, s in got.get(i, []))
        n += len(near)
    return hit / n


def test_recall_on_the_whole_table(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.1", "embeddings").select("vec_id", "embedding").collect()]
    want = _brute(rows)
    for shard in (8192, 600):
        got = _got(nearest(table(spark, "/root/testdata/sf0.1", "embeddings"), shard_nodes=shard))
        assert _recall(got, want) >= 0.98 and all(len(v) == 20 for v in got.values())


def test_op12_is_the_operator_over_the_table(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.001", "embeddings").select("vec_id", "embedding").collect()]
    assert _recall(_got(q.op12_small_world(spark, "/root/testdata/sf0.001")), _brute(rows)) >= 0.98


def test_groups_of_copies_and_of_near_copies(spark):
    r = np.random.default_rng(5)
    base, near = r.normal(size=16), r.normal(size=16)
    rows = [(i, base.tolist(), 1) for i in range(400)]
    rows += [(1000 + i, (near + 0.02 * r.normal(size=16)).tolist(), 2) for i in range(500)]
    rows += [(2000 + i, r.normal(size=16).tolist(), 3) for i in range(300)]
    got, want = _got(nearest(spark.createDataFrame(rows, VECTORS).repartition(7))), _brute(rows)
    assert _recall(got, want) >= 0.95
    for i in range(0, 400, 20):  # of equal vectors the smallest other ids come
        assert got[i] == want[i] or [j for j, _ in got[i]] == [j for j, _ in want[i]]


def test_lengths_differ_so_that_the_product_is_no_cosine(spark):
    r = np.random.default_rng(6)
    rows = [(i, (r.normal(size=8) * r.choice([0.1, 1, 10])).tolist(), 0) for i in range(700)]
    assert _recall(_got(nearest(spark.createDataFrame(rows, VECTORS))), _brute(rows)) >= 0.95


def test_nulls_zeros_ties_repeats_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 0.0], None), (2, [2.0, 0.0], 1), (3, [-1.0, -0.0], 1), (20, [0.0, 1.0], 1), (20, [0.0, 2.0], 1), (40, None, 1), (60, [0.0, 0.0], 1), (80, [], 1),
        (100, [1.0, None], 1), (120, [nan, 1.0], 1), (140, [inf, 1.0], 1), (None, [1.0, 1.0], 1), (160, [1.0, 2.0, 3.0], 1), (161, [3.0, 2.0, 1.0], 1), (-20, [0.5, 0.5], 1), (180, [1.0], 1),
    ]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], VECTORS + ", form int, Score string")
    got, want = _got(nearest(df)), _brute(rows)
    two = got.pop(20)  # one id with two vectors: two queries, and neither finds the other
    assert sorted(two) == sorted(want.pop(20)) and 20 not in [j for j, _ in two]
    _same(got, want)
    assert 180 not in got and [j for j, _ in got[160]] == [161]


def test_empty_table(spark):
    none = spark.createDataFrame([], VECTORS)
    assert nearest(none).count() == 0


def test_graph_is_one_flat_array_with_levels_as_prefixes():
    points = lengthened(np.random.default_rng(7).normal(size=(3000, 12)))
    assert np.allclose((points * points).sum(1), 1, atol=1e-5)
    g = Graph(points)
    flat = g.flat()
    assert flat.dtype == np.int32 and flat.ndim == 1 and g.sizes == [3000, -(-3000 // FAN), -(-(-(-3000 // FAN)) // FAN)]
    assert len(flat) == 3000 * LOW + sum(g.sizes[1:]) * HIGH
    again = Graph.of(points, flat)
    for level, links in enumerate(again.links):
        assert (links == g.links[level]).all() and links.max() < g.sizes[level]
        assert not (links == np.arange(len(links))[:, None]).any()  # no node is its own neighbour
    asked = points[:50]
    assert (again.search(asked)[:, 0] == np.arange(50)).mean() >= 0.98
