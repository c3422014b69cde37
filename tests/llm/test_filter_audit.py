"""The filter audit against a plain reading of its definition, and its edge cases."""

from itertools import permutations

import pytest

from cuelattice.llm.filter_audit import BLOCK, FILTERS, Walk, audit, own_faults, swaps, word_counts

from .common import DOCS, EDGES, empty

LABELS = "doc_id long, quality int, toxic int, part string"


def _brute(docs, labels):
    docs = [(d[0], d[3] or "", d[1] or "") for d in docs]
    good = {i for i, q, *_ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t, *_ in labels if t == 1 and i is not None}
    fails = []
    for i, part, text in docs:
        words = text.encode().split()
        e = i is not None and any(j is not None and j < i and t == text for j, _, t in docs)
        f = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text))
        fails.append((i, part, f + "D" * any(c in "#$%&*|" for c in text) + "E" * e))
    out, shapley = {}, {}
    for part in {p for _, p, _ in fails}:
        for order in permutations(FILTERS):
            here = [(i, f) for i, p, f in fails if p == part]
            kept, all_here = here, here
            for step, x in enumerate(order, 1):
                removed = [(i, f) for i, f in kept if x in f]
                kept = [(i, f) for i, f in kept if x not in f]
                failing = sum(x in f for _, f in all_here)
                out[part, "".join(order), step] = [len(kept), len(removed), failing - len(removed), sum(f == x for _, f in all_here), sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed)]
                shapley[part, x] = shapley.get((part, x), 0) + len(removed)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def _got(df):
    rows = df.collect()
    got = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in rows}
    assert len(got) == len(rows)
    return got


def test_swaps_visit_every_order_once():
    for n in range(1, 6):
        order, seen = list(range(n)), {tuple(range(n))}
        for at in swaps(n):
            order[at], order[at + 1] = order[at + 1], order[at]
            seen.add(tuple(order))
        assert seen == set(permutations(range(n))) and len(swaps(n)) == len(seen) - 1


def test_words_are_those_of_the_whole_text_across_blocks():
    for raw in (b"", b" \t", b"a b a", b"x" * (2 * BLOCK + 5), b"ab cd " * BLOCK, b" " * BLOCK + b"q", "é ü  x".encode()):
        assert word_counts(raw) == (len(raw.split()), len(set(raw.split())))


def test_equals_its_definition_with_edge_cases(spark):
    many = "One Two Three " * 80
    docs = [*EDGES, (20, many, "en", "a", 0), (21, many, "en", "b", 0), (19, many, "en", None, 0), (22, " ".join(f"w{i}" for i in range(250)), "en", "a", 0), (22, many, "en", "a", 0), (23, "cost $5", "en", "b", 0), (None, many, "en", "b", 0)]
    labels = [(20, 1, 0, "x"), (21, 0, 1, "x"), (21, 1, None, None), (None, 1, 1, None), (22, None, None, "x"), (6, 1, 1, "x"), (999, 1, 1, "x")]
    clashing = spark.createDataFrame([(*d, "x") for d in docs], DOCS + ", digest string")
    got = _got(audit(clashing, spark.createDataFrame(labels, LABELS)))
    assert got == _brute(docs, labels)


def test_a_third_of_all_rows_are_copies(spark):
    docs = [(i, "the same text", "en", "hot", 0) for i in range(300)] + [(i, f"text {i} # {'A' * (i % 7)}", "en", f"s{i % 3}", 0) for i in range(300, 900)]
    labels = [(i, i % 2, int(i % 5 == 0), "x") for i in range(0, 900, 3)]
    assert _got(audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))) == _brute(docs, labels)


def test_no_documents_and_no_labels(spark):
    labels = spark.createDataFrame([], LABELS)
    assert audit(empty(spark), labels).count() == 0
    got = _got(audit(spark.createDataFrame(EDGES[:3], DOCS), labels))
    assert got == _brute(EDGES[:3], [])


def test_walk_changes_two_steps_only():
    import numpy as np

    walk = Walk(np.random.default_rng(1).integers(0, 50, (3, 32, 3)))
    for at in swaps(5):
        kept = [k.copy() for k in walk.kept]
        walk.swap(at)
        changed = [i for i in range(5) if not (kept[i] == walk.kept[i]).all()]
        assert set(changed) <= {at} and walk.kept[4].tolist() == walk.counts[:, 0, 0].tolist()


@pytest.mark.parametrize("points,raw,mask", [(0, b"", 1), (7, b"Cost $1", 1 | 4 | 8), (3, "ééé".encode(), 1)])
def test_faults_of_a_text(points, raw, mask):
    assert own_faults(raw, points) == mask
