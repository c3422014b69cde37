import math
import random
import re
import time
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuelattice.llm.common import Scratch, as_bytes, term_blocks
from cuelattice.llm.pii import CHANCE, GENERALISE, KINDS, SUPPORT, base_spans, byte_places, code_points, entity, luhn, revealing_terms, rewrite, sanitise, spelled, terms_of

from .common import DOCS, edges, empty, prose


def _brute(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(d[::-1]))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


bits = st.sampled_from(["a", "b.c", "@", ".", "com", "1", "25", "255", "256", "0001", " ", "-", "+", "+1 (555) 010-1234", "4111 1111 1111 1111", "4111-1111-1111-1112", "(", ")", "é", "\n", "x@y.z", "10.0.0.1", "٣", "%_", "5500000000000004"])


@settings(max_examples=600, deadline=None)
@given(st.lists(bits, max_size=24).map("".join))
def test_spans_are_the_patterns(text):
    assert base_spans(text) == _brute(text)


def test_luhn():
    assert luhn("4111111111111111") and not luhn("4111111111111112") and luhn("0" * 14)


def test_rewrite():
    text = "Ann a@b.co or 10.0.0.1 Ann"
    spans = [(0, 4, 3), *base_spans(text), (23, 4, 26)]
    assert rewrite(text, spans, {23}) == "[NAME] [EMAIL] or [IP] "
    assert rewrite("12 x", [(0, 4, 2)], set()) == "[NUMBER] x"


def test_a_revealing_term(spark):
    # Zebulon stands near one address in different texts and nowhere else; "mail" stands everywhere
    rows = [(i, f"{prose(i, 20)} mail Zebulon {prose(i + 50, 2)} z@corp.example {prose(i + 90, 20)}", "en", "a", 0) for i in range(6)]
    rows += [(i, f"mail {prose(i, 30)}", "en", "a", 0) for i in range(10, 60)]
    rows.append((99, "far away Zebulon again", "en", "a", 0))
    d = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in sanitise(d).collect()}
    for i in range(6):
        assert [KINDS[s.kind] for s in got[i].pii_spans] == ["term", "email"]
        assert "Zebulon" not in got[i].text and "[EMAIL]" in got[i].text and "mail" in got[i].text
    assert [(s.start, s.kind, s.end) for s in got[99].pii_spans] == [(9, 4, 16)]
    assert got[20].text == rows[16][1]
    # the same where the terms are joined, with columns of the names that the join uses
    e = d.withColumns({c: F.lit(c) for c in ("k1", "k2", "found", "removed", "__removed")})
    again = {r.doc_id: r for r in sanitise(e, held=0).collect()}
    assert {i: (r.text, r.pii_spans) for i, r in again.items()} == {i: (r.text, r.pii_spans) for i, r in got.items()}
    assert {(r.k1, r.found, r["__removed"]) for r in again.values()} == {("k1", "found", "__removed")}


def test_terms_anywhere_in_two_documents(spark):
    # the name stands at the top, the number far below it
    rows = [(i, f"Quillon {prose(i, 60)} +1 (555) 010-1234 {prose(i + 9, 9)}", "en", "a", 0) for i in range(2)]
    rows += [(i, prose(i, 60), "en", "a", 0) for i in range(10, 400)]
    got = {r.doc_id: r for r in sanitise(spark.createDataFrame(rows, DOCS)).collect()}
    assert all("Quillon" not in got[i].text and (0, 4, 7) in [(s.start, s.kind, s.end) for s in got[i].pii_spans] for i in range(2))
    assert all(got[i].text == t for i, t, *_ in rows[2:])


def _shares(texts, support=SUPPORT, least=GENERALISE):
    """The revealing terms by plain counting."""
    n, holds, meets, entities = len(texts), Counter(), {}, Counter()
    for t in texts:
        raw, spans = as_bytes(t), base_spans(t)
        every, clear, mark = terms_of(raw, spans)
        holds.update(every.tolist())
        for who in {entity(k, t[s:e]) for s, k, e in spans}:
            entities[who] += 1
            for term in clear.tolist():
                meets.setdefault((who, term), []).append((mark, t))
    out = {}
    for (who, term), docs in meets.items():
        marks = Counter(m for m, _ in set(docs))
        s, both, e, h = sum(marks.values()) ** 2 / sum(v * v for v in marks.values()), len(docs), entities[who], holds[term]
        q, p = both / e, h / n
        if s < support - 1e-9 or p >= q or len({t for t in texts if who in {entity(k, t[a:b]) for a, k, b in base_spans(t)}}) < 2:
            continue
        kl = q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0)
        share = math.log(both * n / (e * h)) / -math.log(e / n) if e < n else 0
        if -s / q * kl <= math.log(CHANCE) and share >= least:
            out[term] = max(share, out.get(term, 0))
    return out


def test_terms_equal_plain_counting(spark):
    r = random.Random(4)
    rows = []
    for i in range(300):
        who = r.choice(["", "", "", f"p{i % 7}@corp.example Name{i % 7}", f"10.0.0.{i % 5} Host{i % 5}", f"q{i}@corp.example"])
        rows.append((i, f"{prose(i, r.randrange(1, 40))} {who} é {prose(i + 1000, 9)}", "en", "a", 0))
    rows += [(300 + i, rows[8][1], "en", "a", 0) for i in range(20)]
    d = spark.createDataFrame(rows, DOCS)
    got = {x.term: x.share for x in revealing_terms(d, Scratch(spark, "test")).collect()}
    want = _shares([x[1] for x in rows])
    assert len(want) > 5 and got.keys() == want.keys()
    assert all(abs(got[t] - want[t]) < 1e-9 for t in want)


def test_texts_of_many_entities_and_terms(spark):
    # two texts with one long list of addresses, and texts that name a few of them
    def rows(entities, terms, own):
        names, body = [f"n{i}@corp.example" for i in range(entities)], [f"t{i}x" for i in range(terms)]
        out = [(i, " ".join([f"o{i}w{k}" for k in range(own)] + names + body), "en", "a", 0) for i in range(2)]
        out += [(10 + 3 * i + c, f"{names[i]} {names[i + 1]} t{i}x Word{i} {prose(3 * i + c, 9)}", "en", "a", 0) for i in range(40) for c in range(3)]
        return out + [(1000 + i, prose(i, 20), "en", "a", 0) for i in range(60)]

    some = rows(45, 60, 60)
    got = {x.term: x.share for x in revealing_terms(spark.createDataFrame(some, DOCS), Scratch(spark, "test")).collect()}
    want = _shares([t for _, t, *_ in some])
    assert want and want.keys() == got.keys() and all(abs(got[t] - want[t]) < 1e-9 for t in want)
    began = time.time()
    revealing_terms(spark.createDataFrame(rows(3000, 60_000, 9), DOCS), Scratch(spark, "test")).count()
    assert time.time() - began < 60  # 180 million pairs if entities of the same texts were not one


def test_blocks_of_terms_change_nothing(spark, monkeypatch):
    r = random.Random(9)
    rows = [(i, f"{prose(i, 40)} p{i % 5}@corp.example Name{i % 5} {prose(r.randrange(9), 9)}", "en", "a", 0) for i in range(80)]
    d = spark.createDataFrame(rows, DOCS)
    whole = {x.term: x.share for x in revealing_terms(d, Scratch(spark, "test")).collect()}
    for name, value in (("PAIRS", 0), ("TERMS", 7)):
        monkeypatch.setattr(f"cuelattice.llm.pii.{name}", value)
    assert {x.term: x.share for x in revealing_terms(d, Scratch(spark, "test")).collect()} == whole != {}


def test_places_of_long_texts():
    # blocks of hashes and code points meet in the middle of runs and of characters
    text = "é" * 300_000 + " a@b.co " + "x" * 700_000 + " 你好 tail"
    raw = as_bytes(text)
    got = [(h, s, e) for part in term_blocks(raw) for h, s, e in zip(*part, strict=True)]
    whole = [m.span() for m in re.finditer(rb"(?:[a-z0-9]|[\x80-\xff])+", raw.tobytes())]
    assert [(s, e) for _, s, e in got] == whole
    points = np.array([0, 5, 299_999, 300_001, 300_008, len(text) - 4, len(text)])
    places = byte_places(raw, points)
    assert places.tolist() == [len(text[:p].encode()) for p in points]
    assert code_points(raw, places).tolist() == points.tolist()


def test_copies_make_no_term_revealing(spark):
    text = f"{prose(1, 20)} unique Zebulon z@corp.example {prose(2, 20)}"
    d = spark.createDataFrame([(i, text, "en", "a", 0) for i in range(30)] + [(99, prose(3, 9), "en", "a", 0)], DOCS)
    assert {len(r.pii_spans) for r in sanitise(d).collect()} == {1, 0}


def test_edges(spark):
    d = edges(spark, pii_spans="clash", term="t", share="s")
    got = sanitise(d)
    assert got.columns == [c for c in d.columns if c != "pii_spans"] + ["pii_spans"]
    rows = got.collect()
    assert len(rows) == d.count() and not any(r.pii_spans for r in rows)
    assert sorted(str(r.text) for r in rows) == sorted(str(r.text) for r in d.collect())
    assert sanitise(empty(spark)).count() == 0
    one = spark.createDataFrame([(1, "é a@b.co, 10.0.0.1", None, None, None)], DOCS)
    assert sanitise(one).select(spelled("pii_spans")).first()[0] == "email:2:8,ip:10:18"
