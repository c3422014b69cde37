import hashlib
import re

from cuelattice.llm.mixing import mix

from .common import edges, empty, prose


def _brute(rows, weights=(1, 2, 3), cap=3):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    target, open_, left = {}, set(sources), float(sum(total.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= cap * total[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: cap * total[s] for s in full}
        left -= sum(cap * total[s] for s in full)
        open_ -= full
    taken = {}
    for s in sources:
        rest = int(target[s] + 0.5)
        docs = sorted((hashlib.md5(f"mix:{i}".encode()).hexdigest(), i) for i, _, x in rows if x == s)
        epochs, rest = divmod(rest, total[s]) if total[s] else (0, 0)
        for _, i in docs:
            part = min(size[i], rest)
            rest -= part
            taken[i] = epochs * size[i] + part
    return size, total, target, taken


def test_equals_brute_force(spark):
    rows = [(i, prose(i, 3 + i * 7 % 90), [None, "a", "b", "src10", "src2", "big", "big", "big"][i % 8]) for i in range(300)]
    size, total, target, taken = _brute(rows)
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["size"], r["source_size"], r["taken"]) == (size[r.doc_id], total[r.source], taken[r.doc_id])
        assert abs(r["target"] - target[r.source]) < 1e-6 * max(1, target[r.source])
        assert r["taken"] <= 3 * r["size"]


def test_edges(spark):
    d = edges(spark, taken="x", size="y", target="z", key="k", epochs="e")
    got = mix(d).collect()
    assert len(got) == d.count()
    assert all(r["size"] == 0 and r["taken"] == 0 for r in got if not (r["text"] or "").strip())
    assert {r["key"] for r in got} == {"k"}
    again = mix(d).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mix(empty(spark)).count() == 0


def test_only_empty_texts(spark):
    d = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert [(r["target"], r["taken"]) for r in mix(d).collect()] == [(0.0, 0), (0.0, 0)]
