"""The registered queries against SQL or a brute-force version, over whole small tables."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelattice.llm import queries as q
from cuelattice.llm.common import table
from cuelattice.llm.language import fit, identify
from cuelattice.llm.licenses import NOTICES, TEMPLATES, Templates, scan
from cuelattice.llm.media import payload_of

from .test_cover_tree import _brute as brute_links
from .test_minhash import _brute as brute_classes
from .test_pii import _brute as brute_spans

SF = "/root/testdata/sf0.001"
KINDS = ("email", "ip", "card", "phone")


def _texts(spark):
    return {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(q.oracle_sql()[name])
    got = q.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())


def test_op4_reads_back_every_document(spark):
    from .test_packing import _plain

    rows, texts = q.op4_packing(spark, SF).collect(), _texts(spark)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(texts)
    for i, pieces in by.items():
        ids = np.array([*_plain(texts[i] or ""), 2], "<u4")
        for k, r in enumerate(sorted(pieces, key=lambda r: r.piece)):
            assert r.piece == k and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert sum(r.length for r in pieces) == len(ids)


def test_op7_equals_brute_force(spark):
    texts, seen = _texts(spark), {}
    for r in q.op7_media(spark, SF).collect():
        p = payload_of(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((texts[r.doc_id] or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert seen.setdefault(texts[r.doc_id], r[1:8]) == r[1:8]
    assert len(texts) == table(spark, SF, "documents").count()


def test_op8_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, SF, "embeddings").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in q.op8_cover_tree(spark, SF).collect()}
    assert got == brute_links(rows)


def test_op9_equals_brute_force(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in q.op9_circulant_minhash(spark, SF).collect()}
    assert got == brute_classes(sorted(_texts(spark).items()))


def test_op10_equals_brute_force(spark):
    texts, found = _texts(spark), 0
    for r in q.op10_pii(spark, SF).collect():
        spans = brute_spans(texts[r.doc_id] or "")
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[1] == k for s in spans) for k in range(4)]
        said = [f"{KINDS[k]}:{a}:{b}" for a, k, b in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("term")] == said
        assert r.n_term == r.spans.count("term:")
        found += len(spans)
    assert found > 0


def test_op5_covers_its_table(spark):
    pages = q.op5_html(spark, SF).collect()
    assert len(pages) == table(spark, SF, "pages").count() and all(r.text and r.n_chars == len(r.text) for r in pages)


def test_op6_covers_its_table(spark):
    got = q.op6_language(spark, SF).collect()
    assert len(got) == table(spark, SF, "documents").count() and all(r.kept for r in got)
    assert all(r.declared == r.language for r in got)


def test_language_on_held_out_rows(spark):
    # fitted on one half, judged on the other by the text alone, then with host priors, never with the label
    d = table(spark, "/root/testdata/sf0.01", "documents")
    model = fit(d.where("doc_id % 2 = 0"), q.LANGUAGES)
    rest = d.where("doc_id % 2 = 1")
    for host in (None, F.col("source")):
        right, n = identify(rest, model, host=host).agg(F.count_if(F.col("language") == F.col("lang")), F.count("*")).first()
        assert right >= 0.99 * n


def test_language_of_pages(spark):
    got = q.language_of_pages(spark, SF).collect()
    assert len(got) == table(spark, SF, "pages").count() and {r.declared for r in got} <= set(q.LANGUAGES)
    assert sum(r.language == r.declared for r in got) >= 0.98 * len(got)


def test_op2_finds_every_notice(spark):
    # the whole table against a search for each template's words in order, whatever the white space between them
    texts = {i: " ".join((t or "").lower().split()) for i, t in _texts(spark).items()}
    got, met = {(r.doc_id, r.template) for r in q.op2_licenses(spark, SF).collect()}, 0
    for k, (_, template) in enumerate(TEMPLATES + NOTICES):
        words = " ".join(template.lower().split())
        for i, t in texts.items():
            if f" {words} " in f" {t} ":
                met += 1
                assert (i, k) in got
    assert met > 0
    known = [(i, k, c) for i, t in _texts(spark).items() for k, c, _, _ in scan(t, Templates(TEMPLATES + NOTICES))]
    assert sorted(known) == sorted((r.doc_id, r.template, r.held) for r in q.op2_licenses(spark, SF).collect())
