import random

import corpus_pipeline
from cuelattice.llm.common import table

from pyspark.sql import functions as F

from .common import DOCS, edges, empty, prose

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "pii", "mixing", "packing"]
    docs = table(spark, SF, "documents")
    base = docs.where("doc_id < 60").collect()
    r = random.Random(1)
    long = max(base, key=lambda x: len(x.text))
    near = " ".join(w if r.random() > 0.01 else "edited" for w in long.text.split())
    extra = [(1000, long.text, "en", "src0", 1), (1001, near, "en", "src0", 1), (1002, "%% 12 --", "en", "src0", 1), (1003, prose(1, 40) + " me@x.example 10.1.2.3", "en", "src1", 1)]
    d = spark.createDataFrame([tuple(x) for x in base] + extra, DOCS).cache()
    kept = corpus_pipeline.language(spark, d, SF).cache()
    assert kept.columns == d.columns and {x.doc_id for x in d.collect()} - {x.doc_id for x in kept.collect()} <= {1002, 1003}
    alone = corpus_pipeline.deduplicate(spark, d, SF).cache()
    left = {x.doc_id for x in alone.collect()}
    assert left & {1000, 1001} == set() and long.doc_id in left and alone.columns == d.columns
    clean = corpus_pipeline.private(spark, alone, SF).cache()
    text = {x.doc_id: x.text for x in clean.collect()}
    assert set(text) == left and text[1003].endswith("[EMAIL] [IP]")
    mixed = corpus_pipeline.mixed(spark, clean, SF).cache()
    assert mixed.columns == d.columns
    words = lambda t: len((t or "").split())
    whole = {x.source: 0 for x in clean.collect()}
    for x in clean.collect():
        whole[x.source] += words(x.text)
    taken = sum(words(x.text) for x in mixed.collect())
    assert abs(taken - sum(whole.values())) <= len(whole)
    assert all(x.text == text[x.doc_id] or text[x.doc_id].startswith(x.text) for x in mixed.collect())
    packed = corpus_pipeline.packed(spark, mixed, SF)
    assert packed.where("size(ids) <> length").count() == 0 and packed.count() >= mixed.count()


def test_edges(spark):
    d = edges(spark)
    n = d.count()
    texts = [x.text for x in d.collect()]
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, d, SF).collect()
        if name == "language":
            assert all(any(c.isalpha() for c in x.text) for x in got) and 0 < len(got) < n
        elif name == "near_duplicates":
            assert sum(x.doc_id == 6 for x in got) == 1 and sum(x.doc_id is None for x in got) == 2 and len(got) == n - 2
        elif name == "pii":
            assert sorted(map(str, (x.text for x in got))) == sorted(map(str, texts))
        elif name == "packing":
            assert len({x.sequence_id for x in got}) < len(got) and len(got) >= n
        else:
            assert got and all(any((t or "").startswith(x.text or "") for t in texts) for x in got)
        assert stage(spark, empty(spark), SF).count() == 0


def test_columns_of_any_name_stay_as_they_are(spark):
    names = "language confidence accepted pii_spans size source_size target epochs taken again id text_key key_of dropped full rest copy key cut_key partial __key __x __removed k1 found group".split()
    d = spark.createDataFrame([(i, f"the and with that {prose(i, 30)} a{i % 4}@b.example", "en", "s", 9) for i in range(12)], DOCS)
    e = d
    for c in names:
        e = e.withColumn(c, F.concat(F.lit(f"{c} of "), F.col("doc_id")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, e, SF)
        assert got.columns == e.columns
        rows = got.collect()
        assert rows and all(x[c] == f"{c} of {x.doc_id}" for x in rows for c in names)
        plain = stage(spark, d, SF).collect()
        assert sorted((x.doc_id, x.text) for x in rows) == sorted((x.doc_id, x.text) for x in plain)


def test_rows_of_one_id_are_told_apart_by_their_texts(spark):
    a, b, c = prose(1, 50), prose(2, 50), prose(3, 50)
    rows = [(1, a), (1, b), (2, a), (3, c), (3, c), (None, b), (None, prose(4, 50)), (None, prose(4, 50)), (4, ""), (4, ""), (5, "")]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = sorted((str(x.doc_id), x.text) for x in corpus_pipeline.deduplicate(spark, d, SF).collect())
    assert got == sorted([("1", a), ("1", b), ("3", c), ("None", prose(4, 50)), ("4", ""), ("5", "")])


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and got.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0
