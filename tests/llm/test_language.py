import math
import random

import numpy as np
from pyspark.sql import functions as F

from cuelattice.llm import language as lg
from cuelattice.llm.language import UNKNOWN, fit, fused, identify, trigrams

from .common import DOCS, edges, empty

WORDS = {"en": "the and with that from this have which there about would".split(), "de": "der und nicht sich auch werden eine durch über können".split(), "fr": "le les des une avec pour dans être après leur été".split()}


def _text(lang, seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[lang]) for _ in range(n))


def _labelled(spark, n=300):
    return spark.createDataFrame([(i, _text(lang, i, 30), lang, f"src{i % 5}", 0) for i in range(n) for lang in [list(WORDS)[i % 3]]], DOCS)


def test_held_out_accuracy(spark):
    model = fit(_labelled(spark), tuple(WORDS))
    test = spark.createDataFrame([(i, _text(lang, 10_000 + i, 8), lang, "h", 0) for i in range(300) for lang in [list(WORDS)[i % 3]]], DOCS)
    got = identify(test, model).agg(F.avg((F.col("language") == F.col("lang")).cast("double"))).first()[0]
    assert got >= 0.98


def test_evidence_beyond_the_text(spark):
    model = fit(_labelled(spark), tuple(WORDS))
    # one ambiguous word on hosts with a clear language
    rows = [(i, _text("de", i, 40), None, "de-host", 0) for i in range(200)] + [(i, _text("fr", i, 40), None, "fr-host", 0) for i in range(200, 400)]
    rows += [(900, "xq", None, "de-host", 0), (901, "xq", None, "fr-host", 0), (902, "xq", None, "new-host", 0), (903, "xq", "en-GB", "new-host", 0)]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(rows, DOCS), model, host=F.col("source"), declared=F.col("lang")).collect()}
    assert got[900].language == "de" and got[901].language == "fr" and got[903].language == "en"
    assert got[902].confidence < got[900].confidence
    suffix = identify(spark.createDataFrame(rows[-2:-1], DOCS), model, suffix=F.lit("at")).first()
    assert suffix.language == "de"


def test_domains_stand_between_hosts_and_corpus(spark):
    model = fit(_labelled(spark), tuple(WORDS))
    # a new host of a German domain, a new host of a new domain, and a French host of the German domain
    rows = [(i, _text("de", i, 40), None, f"h{i % 3}.de-firm", 0) for i in range(120)] + [(i, _text("fr", i, 40), None, "fr.de-firm", 0) for i in range(200, 300)]
    rows += [(i, _text("en", i, 40), None, "x.other", 0) for i in range(300, 700)]
    rows += [(900, "xq", None, "new.de-firm", 0), (901, "xq", None, "new.unseen", 0), (902, "xq", None, "fr.de-firm", 0)]
    domain = F.element_at(F.split("source", r"\."), -1)
    got = {r.doc_id: r for r in identify(spark.createDataFrame(rows, DOCS), model, host=F.col("source"), domain=domain).collect()}
    assert (got[900].language, got[901].language, got[902].language) == ("de", "en", "fr")


def test_columns_of_any_name_stay(spark):
    model = fit(_labelled(spark), tuple(WORDS))
    d = _labelled(spark, 9)
    for c in ("__x", "host", "domain", "declared", "suffix", "host_counts", "domain_counts"):
        d = d.withColumn(c, F.lit(f"my {c}"))
    got = identify(d, model, host=F.col("host"), declared=F.col("lang"))
    assert got.columns == [*d.columns, "language", "confidence", "accepted"]
    assert all(r["__x"] == "my __x" and r.host_counts == "my host_counts" and r.language == r.lang for r in got.collect())


def _softmax(log):
    top = max(log)
    each = [math.exp(x - top) for x in log]
    return [x / sum(each) for x in each]


def _plain(model, rows):
    """(language, posterior) of each row (text, host, domain, declared, suffix), from the definition, row by row."""
    names, k = list(model.languages), len(model.languages) + 1
    flat = [(1 - lg.UNKNOWN_PRIOR) / (k - 1)] * (k - 1) + [lg.UNKNOWN_PRIOR]
    logs, shares = [], []
    for text, _, _, declared, suffix in rows:
        log = [0.0] * k
        for gram in trigrams(text or ""):
            log = [a + lg.TEMPER * float(b) for a, b in zip(log, model.table[gram])]
        for said, right in ((declared.split("-")[0].lower() if declared else None, lg.DECLARED), (lg.SUFFIXES.get(suffix), lg.SUFFIX)):
            if said in names:
                log = [a + math.log(right if c == names.index(said) else 1 / (k - 1) if c == k - 1 else (1 - right) / (k - 1)) for c, a in enumerate(log)]
        logs.append(log)
        shares.append([round(1000 * p) / 1000 for p in _softmax([a + math.log(f) for a, f in zip(log, flat)])])
    letters = [len(trigrams(r[0] or "")) > 0 for r in rows]
    out = []
    for i, (_, host, domain, _, _) in enumerate(rows):
        prior = flat
        for of in (lambda r: True, lambda r: domain and r[2] == domain, lambda r: host and (r[2] or "", r[1]) == (domain or "", host)):
            # the evidence of all other rows of the level; a row without letters has none
            seen = [sum(shares[j][c] for j, r in enumerate(rows) if j != i and letters[j] and of(r)) for c in range(k)]
            prior = [(s + lg.BORROW * p) / (sum(seen) + lg.BORROW) for s, p in zip(seen, prior)]
        p = _softmax([a + math.log(b) for a, b in zip(logs[i], prior)])
        best = max(range(k), key=lambda c: p[c])
        out.append(([*names, UNKNOWN][best] if letters[i] else UNKNOWN, p[best]))
    return out


def test_posteriors_equal_the_definition_row_by_row(spark):
    model, r = fit(_labelled(spark), tuple(WORDS)), random.Random(8)
    rows = []
    for i in range(160):
        lang = r.choice(list(WORDS))
        text = r.choice([_text(lang, i, r.randrange(1, 7)), "xq", "", None, "12 -- 3"])
        rows.append((text, r.choice(["h1", "h2", "h3", ""]), r.choice(["d1", "d2", ""]), r.choice([lang, "en-GB", "zz", None]), r.choice(["de", "at", "fr", "uk", "com", None])))
    d = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, text string, h string, d string, said string, tld string").repartition(5)
    got = identify(d, model, host=F.col("h"), domain=F.col("d"), declared=F.col("said"), suffix=F.col("tld")).orderBy("i").collect()
    for x, (language, p) in zip(got, _plain(model, rows), strict=True):
        assert abs(x.confidence - p) < 2e-4 and (x.language == language or abs(p - 0.5) < 1e-3), x


def test_own_share_is_taken_out():
    own, mine = np.log(np.array([0.5, 0.3, 0.2])), np.array([0.9, 0.1, 0.0])
    alone = fused(own, mine, [mine], True)
    assert np.allclose(alone, fused(own, np.zeros(3), [np.zeros(3)], True))


def test_unknown_language_and_edges(spark):
    model = fit(_labelled(spark), tuple(WORDS))
    d = edges(spark, language="x", accepted="y", confidence="z").unionByName(spark.createDataFrame([(20, "12 %% -- 3", "en", "a", 0)], DOCS), allowMissingColumns=True)
    got = identify(d, model, host=F.col("source"), declared=F.col("lang")).collect()
    assert len(got) == d.count()
    for r in got:
        if not any(c.isalpha() for c in r.text or ""):
            assert r.language == UNKNOWN and not r.accepted
    assert identify(empty(spark), model, host=F.col("source")).count() == 0
    none = fit(empty(spark), tuple(WORDS))
    assert identify(d, none).count() == d.count()
