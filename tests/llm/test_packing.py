import random
import zlib
from functools import cache

import numpy as np
import pytest

from cuelattice.llm.packing import _ODD, Ids, cut, odd, pack, sum_of_squares
from cuelattice.llm.queries import vocabulary

from .common import DOCS, edges, empty, prose

PATH = vocabulary("byte_bpe_50k.json")


@cache
def _tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def _plain(text):
    return _tokenizer().encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def ids():
    return Ids(PATH)


@pytest.mark.parametrize("seed", range(6))
def test_ids_are_the_tokenizers(seed, ids):
    r = random.Random(seed)
    bits = [" ", "\n", "  ", "a", "The", "don't", "é", "ß", "9", "42", ".", ",", "'s", "\t", "你好", "<|endoftext|>", " ", "\r\n", " \n", "¡", "_", "#", "\U0001f600", "x́"]
    for _ in range(1500):
        text = "".join(r.choice(bits) for _ in range(r.randrange(14)))
        assert np.frombuffer(ids.of(text), "<u4").tolist() == _plain(text), repr(text)


def test_added_tokens_are_read_as_the_tokenizer_reads_them(ids):
    text = "a <|endoftext|> b"
    assert np.frombuffer(ids.of(text), "<u4").tolist() == _plain(text) and 50256 in _plain(text)


def test_cut():
    assert cut(5, 10) == [(0, 5)] and cut(10, 10) == [(0, 10)] and cut(25, 10) == [(0, 5), (5, 10), (15, 10)]


def test_bins_hold_what_they_can():
    r = np.random.default_rng(1)
    lengths = np.sort(r.integers(1, 1025, 3000))[::-1]
    bins, offsets = sum_of_squares(lengths, 1024)
    for b in range(bins.max() + 1):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(offsets[own])]
        assert offsets[own].tolist() == np.concatenate(([0], np.cumsum(lengths[own])[:-1])).tolist()
        assert lengths[own].sum() <= 1024
    assert bins.max() + 1 <= 1.02 * lengths.sum() / 1024 + 1


def test_edges(spark):
    d = edges(spark, piece="x", sequence_id="y", shard="z")
    got = pack(d, PATH, shard_docs=4, with_ids=True).collect()
    assert len({(r.doc_id, r.ids_crc32) for r in got if r.doc_id is not None}) >= 9
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for rows in by.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    seven = sorted((r for r in got if r.doc_id == 7), key=lambda r: r.piece)
    from .common import LONG

    assert [i for r in seven for i in r.ids] == _plain(LONG) + [2]
    assert all(r.length == 1024 for r in seven[1:]) and [r.piece for r in seven] == list(range(len(seven)))
    assert sorted(r.length for r in got if r.doc_id in (1, 2)) == [1, 1]
    assert sum(r.doc_id == 6 for r in got) == 2
    assert pack(empty(spark), PATH).count() == 0


def test_sequences_do_not_hang_on_the_split(spark):
    d = spark.createDataFrame([(i % 90, prose(i % 100, 30 + i % 100), "en", "a", 0) for i in range(300)], DOCS)
    one, many = (sorted(tuple(r) for r in pack(d.repartition(n), PATH, shard_docs=50).collect()) for n in (1, 7))
    assert one == many
    # equal rows in number are dealt out
    d = spark.createDataFrame([(1, "the same row", "en", "a", 0)] * 400, DOCS)
    got = pack(d.repartition(3), PATH, shard_docs=100).collect()
    assert len(got) == 400 and len({r.sequence_id >> 40 for r in got}) == 4


def test_odd_texts_are_those_of_the_pattern():
    r = random.Random(1)
    for _ in range(3000):
        t = "".join(r.choice("ab \n\t\x00\x7f\x1f~!é\xa0\xad\u0180€") if r.random() < 0.3 else "x" for _ in range(r.randrange(12)))
        assert odd(t) == bool(_ODD.search(t)), repr(t)


@pytest.mark.parametrize("same", [350, 40])
def test_equal_rows_leave_the_others_where_they_are(spark, same):
    rows = [(1, "the same row " * 20, "en", "a", 0)] * same + [(i, prose(i, 30 + i), "en", "a", 0) for i in range(2, 52)]
    got = []
    for n in (3, 7):
        d = spark.createDataFrame(rows, DOCS).repartition(n)
        got.append(sorted(tuple(r) for r in pack(d, PATH, shard_docs=100).collect()))
    assert got[0] == got[1] and sum(r[0] == 1 for r in got[0]) == same


def test_few_sequences(spark):
    rows = [(i, prose(i, 5 + i * 37 % 400), "en", "a", 0) for i in range(600)]
    got = pack(spark.createDataFrame(rows, DOCS), PATH)
    n, tokens = got.select("sequence_id").distinct().count(), got.selectExpr("sum(length)").first()[0]
    assert n <= 1.03 * tokens / 1024 + 2


def test_few_known_words_give_the_same_ids():
    texts = ["a plain text of words", "a text again\nand words", "other plain words"] * 3
    few = Ids(PATH, 4)
    assert list(few.of_many(texts)) == list(Ids(PATH).of_many(texts))
    assert [few.of(t) for t in texts] == list(Ids(PATH).of_many(texts))
