import random

import numpy as np

from cuelattice.llm.common import shingle_hashes, word_hashes
from cuelattice.llm.licenses import MISS, NOTICES, TEMPLATES, Templates, bands, scan, scan_licenses, similarity

from .common import edges, empty, prose


def _edited(text, r, share):
    return " ".join(w if r.random() > share else "edited" for w in text.split())


def test_equals_brute_force():
    known, r = Templates(TEMPLATES), random.Random(5)
    held = 0
    for seed in range(150):
        parts = [prose(seed, r.randrange(0, 300))]
        for _ in range(r.randrange(3)):
            parts += [_edited(r.choice(TEMPLATES)[1], r, r.choice([0, 0.01, 0.04])), prose(seed + 1000, r.randrange(0, 80))]
        text = "\n".join(parts)
        s = np.unique(shingle_hashes(word_hashes(text)))
        want = {i: len(np.intersect1d(s, t)) for i, t in enumerate(known.sets)}
        got = {i: c for i, c, _, _ in scan(text, known)}
        # what is held in one place is found with all its shingles
        assert got == {i: c for i, c in want.items() if c >= 0.75 * len(known.sets[i])}
        held += len(got)
    assert held > 100


def test_bands_guarantee_collisions():
    for k in range(10):
        assert similarity(k) > 0.23
        assert similarity(k) == 1 or (1 - similarity(k)) ** bands(k) <= MISS


def test_edges(spark):
    d = edges(spark, license="mine", held="h").unionByName(spark.createDataFrame([(9, "x Licensed under CC BY-NC 4.0. y", "en", "a", 3, "q", "r")] * 2, "doc_id long, text string, lang string, source string, n_chars long, license string, held string"))
    got = scan_licenses(d).collect()
    assert [(r.doc_id, r.license, r.word) for r in got] == [(9, "CC-BY-NC-4.0", 1)] * 2
    assert scan_licenses(empty(spark)).count() == 0
    assert scan_licenses(d, []).count() == 0
    assert scan_licenses(d, [("short", "one two"), ("none", "")]).count() == 2  # documents 4 and 5


def test_every_short_notice_wherever_it_stands(spark):
    short = [(i, n, t) for i, (n, t) in enumerate(TEMPLATES + NOTICES) if len(t.split()) < 6]
    assert [n for _, n, _ in short] == ["MIT", "CC-BY-NC-4.0", "All-Rights-Reserved"]
    for i, name, t in short:
        for k, text in enumerate((t, f"{prose(1, 30)}\n{t}\n{prose(2, 30)}", f"{prose(1, 7)} ({t})", f"{prose(1, 7)} {t[:-1]}, {prose(3, 9)}", f"é – “x” {t.upper()}")):
            d = spark.createDataFrame([(1, text)], "doc_id long, text string")
            got = [(r.license, r.template, r.held, r.word) for r in scan_licenses(d).collect()] if k in (1, 2) else [((TEMPLATES + NOTICES)[j][0], j, c, w) for j, c, _, w in scan(text, Templates(TEMPLATES + NOTICES))]
            assert got == [(name, i, 1, (0, 30, 7, 7, 3)[k])]
    known = Templates(TEMPLATES + NOTICES)
    assert scan("all rights are reserved", known) == scan("overall rights reserved", known) == []
    for i, (_, t) in enumerate(TEMPLATES + NOTICES):
        assert i in [j for j, *_ in scan(f"{prose(5, 40)}\n{t}\n{prose(6, 40)}", known)]
