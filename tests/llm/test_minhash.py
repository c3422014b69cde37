import random

import numpy as np

from cuelattice.llm.circulant_minhash import near_duplicates, signature, sketch
from cuelattice.llm.common import shingle_set

from .common import DOCS, edges, empty, prose


def _edit(text, r, share):
    return " ".join(w if r.random() > share else f"new{r.randrange(10**6)}" for w in text.split())


def _brute(rows):
    words = {i: (t or "").lower().split() for i, t in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_equals_brute_force(spark):
    r, rows = random.Random(1), []
    for g in range(12):
        base = prose(g, r.choice([6, 12, 60, 400]))
        rows += [_edit(base, r, r.choice([0, 0.002, 0.01, 0.03, 0.05])).upper() if k % 3 else base for k in range(14)]
    rows += [prose(100 + k, 40) for k in range(30)]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    d = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates(d).collect()}
    assert got == _brute(rows)


def test_edges(spark):
    d = edges(spark, component_id="x", kept="y", n="z", bucket="b")
    got = sorted(near_duplicates(d).collect(), key=str)
    by = {r.doc_id: r for r in got}
    assert len(got) == d.count()
    assert all(by[i].n_shingles == 0 and by[i].component_id == i and by[i].kept for i in (1, 2, 3))
    assert by[5].component_id == 4 and not by[5].kept and by[4].n_shingles == 1
    assert sum(r.doc_id == 6 and r.kept for r in got) == 2
    assert all(r.component_id is None and not r.kept for r in got if r.doc_id is None)
    # a row without id says which id it is a copy of; different texts of one id are judged each by itself
    a, b = prose(1, 60), prose(2, 60)
    d = spark.createDataFrame([(7, a, "", "", 0), (7, b, "", "", 0), (9, "start " + b, "", "", 0), (None, a, "", "", 0), (None, b + " end", "", "", 0)], DOCS)
    got = [(r.doc_id, r.component_id, r.kept) for r in near_duplicates(d).collect()]
    assert sorted(got, key=str) == sorted([(7, 7, True), (7, 7, True), (9, 7, False), (None, 7, False), (None, 7, False)], key=str)
    assert near_duplicates(empty(spark)).count() == 0


def test_templated_pages_are_compared_whole(spark):
    # a template that makes them share buckets but keeps them below the similarity; two pairs are above it
    r = random.Random(7)
    rows = []
    for i in range(150):
        own = [f"own{i}x{r.randrange(10**6)}" for _ in range(40)]
        rows.append((i, prose(1, 100) + " " + " ".join(own)))
        if i in (20, 90):
            rows.append((1000 + i, prose(1, 100) + " " + " ".join([*own[:38], "other", "end"])))
    d = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates(d).collect()}
    assert got == _brute(rows) and sum(i != c for i, (_, c) in got.items()) == 2


def test_estimates():
    r = np.random.default_rng(0)
    for n in (40, 400, 4000):
        e = r.integers(0, 2**63, n).astype(np.uint64)
        a, b = e[: int(n * 0.875)], e[int(n * 0.125) :]  # similarity 0.75
        same = (signature(a) == signature(b)).mean()
        assert abs(same - 0.75) < 0.16
        assert sketch(a).shape == (64,)
    assert len(shingle_set(None)) == len(shingle_set(" \n")) == 0 and len(shingle_set("a b")) == 1
