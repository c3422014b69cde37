"""Repaired conversations against a plain search of all edits, and edge cases."""

import hashlib
import random
import zlib
from functools import lru_cache
from itertools import product

import pytest

from cuelattice.llm import queries as q
from cuelattice.llm.common import table
from cuelattice.llm.conversation_repair import RESULT, crossing, damage, layered, repair

TURNS = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def _legal(state, initial):
    """The state after an initial, or None."""
    if initial == "s":
        return "s" if state == "" else None
    return initial if initial in ("u", "a") and NEXT[state] == initial else None


def _search(rows):
    """(cost, audit, repaired rows) by trying every edit everywhere; rows: (role, text, fault)."""

    @lru_cache(None)
    def best(at, state, inserts):
        found = [(0, "", ())] if at == len(rows) and state in ("", "a") else []
        free = NEXT[state]
        name = "user" if free == "u" else "assistant"
        if inserts < 3:
            c, a, r = best(at, free, inserts + 1)
            found.append((c + 3, "I" + a, (f"{name}:", *r)))
        if at < len(rows):
            role, text, fault = rows[at]
            c, a, r = best(at + 1, state, 0)
            found.append((c + 4, "D" + a, r))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                c, a, r = best(at + 1, free, 0)
                found.append((c + 3 + more, "R" + a, (f"{name}:{text}", *r)))
                if (new := _legal(state, role[:1])) is not None:
                    c, a, r = best(at + 1, new, 0)
                    found.append((c + more, "K" + a, (f"{role}:{text}", *r)))
        return min(found, default=(10**9, "", ()))

    for at in range(len(rows), -1, -1):  # from the end on, so that no call goes deep
        for state in NEXT:
            best(at, state, 0)
    return best(0, "", 0)


def _brute(originals, damaged=True):
    out = {}
    for conv in {r[0] for r in originals}:
        rows = []
        for c, turn, role, text in originals:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
            fault = zlib.crc32(key.encode()) % 20 if damaged else 19
            if fault == 0:
                continue
            text = "" if fault == 1 else "".join(x for x in text if x not in ".!?") if fault == 2 else text
            rows += [(turn, "user" if fault == 4 else role, text)] * (1 + (fault == 3))
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, marked = set(), []
        for _, role, text in rows:
            end = text.rstrip(SPACES)[-1:]
            marked.append((role, text, "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else ""))
            seen.add((role, text))
        cost, audit, after = _search(tuple(marked))
        turns = [t for t, *_ in rows if t is not None]
        count = [sum(f == k for *_, f in marked) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count, illegal, cost, audit, hashlib.sha256("\n".join(after).encode()).hexdigest())
    return out


def _got(df):
    assert [c.split()[0] for c in RESULT.split(", ")] == df.columns
    rows = df.collect()
    got = {r[0]: tuple(r[1:]) for r in rows}
    assert len(got) == len(rows)
    return got


def _random(seed, convs, most):
    r = random.Random(seed)
    texts = ["Fine.", "Well!", "cut off", "", " \n", "A longer one?  ", "Yes."]
    return [(c, t, r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), r.choice([*texts, None, f"Said {r.random()}."])) for c in range(convs) for t in sorted(r.sample(range(most * 2), r.randrange(most + 1)))]


def test_equals_the_search_of_all_edits(spark):
    rows = _random(1, 300, 9)
    df = spark.createDataFrame(rows, TURNS)
    assert _got(repair(damage(df), df)) == _brute(rows)
    assert _got(repair(df, df)) == _brute(rows, damaged=False)


@pytest.mark.parametrize("chunk", [1, 3, 7])
def test_conversations_of_many_chunks(spark, chunk):
    rows = _random(2, 12, 60)
    df = spark.createDataFrame(rows, TURNS)
    assert _got(repair(damage(df), df, chunk)) == _brute(rows)


def test_one_conversation_of_a_third_of_all_rows(spark):
    rows = [(7, t, *x) for t, x in enumerate((r[2], r[3]) for r in _random(3, 60, 30))] + [(100 + r[0], *r[1:]) for r in _random(4, 150, 8)]
    df = spark.createDataFrame(rows, TURNS).repartition(8)
    assert _got(repair(damage(df), df, 16)) == _brute(rows)


def test_nulls_ties_repeats_and_clashing_names(spark):
    rows = [
        (None, None, None, None), (None, 1, "user", "Hello."), (None, 1, "user", "Hello."), (1, None, "system", "Be kind."), (1, 5, "assistant", "Right."),
        (1, 5, "user", "Ask?"), (1, 5, "user", "Ask?"), (2, 0, "user", "\x1f"), (3, 2, "user", "é ü."), (3, 2, "assistant", "x" * 300_000), (3, 9, "assistant", "x" * 300_000),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS + ", digest string, Cost int")
    assert _got(repair(damage(df), df)) == _brute(rows)
    assert _got(repair(df, df, 2)) == _brute(rows, damaged=False)


def test_empty_tables_and_conversations_without_rows(spark):
    none = spark.createDataFrame([], TURNS)
    assert repair(none, none).count() == 0
    df = spark.createDataFrame([(1, 0, "user", "Hello.")], TURNS)
    assert _got(repair(none, df)) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_cost_and_tables_of_chunks_by_enumeration():
    # every byte of a row, all short sequences: the least cost over all edit sequences that end well
    kinds = [i | f << 2 for i, f in product(range(4), (0, 1, 3))]
    names = {0: "user", 1: "assistant", 2: "system", 3: "tool"}
    faults = {0: "", 1: "blank", 3: "truncated"}
    for marks in (m for n in range(3) for m in product(kinds, repeat=n)):
        cost, _ = layered(bytes(marks), None, 0)
        assert cost == _search(tuple((names[m & 3], "t", faults[m >> 2]) for m in marks))[0]
        assert crossing(bytes(marks))[4][0] == cost


def test_op13_equals_brute_force(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.01", "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = _got(q.op13_conversation_repair(spark, "/root/testdata/sf0.01"))
    assert got == _brute(rows) and len({v[6] for v in got.values()}) > 20
