import random
import tracemalloc

import numpy as np
import pytest

from cuelattice.llm import common
from cuelattice.llm.circulant_minhash import signature
from cuelattice.llm.common import BLOCK, fresh, run_blocks, shingle_hashes, shingle_set, term_blocks, word_hashes
from cuelattice.llm.licenses import NOTICES, TEMPLATES, Templates, scan

from .common import prose


def _runs(text):
    parts = list(run_blocks(common.as_bytes(text)))
    return [np.concatenate([p[i] for p in parts]).tolist() for i in range(3)] if parts else [[], [], []]


def test_blocks_change_nothing(monkeypatch):
    r = random.Random(1)
    texts = ["", " ", "a", "a b", "x" * 70, " " * 70, *("".join(r.choice("ab  Zé\n") for _ in range(r.randrange(200))) for _ in range(200))]
    want = [_runs(t) for t in texts]
    shingles = [shingle_set(t).tolist() for t in texts]
    monkeypatch.setattr(common, "BLOCK", 7)
    common._up_down.cache_clear()
    assert [_runs(t) for t in texts] == want
    assert [shingle_set(t).tolist() for t in texts] == shingles
    monkeypatch.undo()
    common._up_down.cache_clear()


def test_equal_words_have_equal_hashes():
    long = "w" * (BLOCK + 10)
    h = word_hashes(f"one {long} ONE {'  ' * BLOCK} One {long.upper()}")
    assert h[0] == h[2] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 2
    assert len(shingle_hashes(h)) == 1 and len(shingle_hashes(h[:3])) == 1


@pytest.mark.parametrize("use", ["signature", "scan", "terms"])
def test_memory_of_a_long_text_is_bounded(use):
    raw = common.as_bytes((prose(1, 5000) + " ") * 600 + TEMPLATES[0][1])  # 20 MB, 3 million words
    known = Templates(TEMPLATES + NOTICES)
    tracemalloc.start()
    if use == "signature":
        signature(shingle_set(raw))
    elif use == "scan":
        assert [i for i, *_ in scan(raw, known)] == [0]
    else:
        sum(len(h) for h, _, _ in term_blocks(raw))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 4 * len(raw)


def test_fresh_names():
    assert fresh(["a", "_A"], "A", "b", "b") == ["__A", "b", "_b"]
