"""Repair of conversations: the cheapest edits after which roles follow a grammar, with an audit of them.

Roles must read (s?(ua)+)? by their initials. The search goes through cost layers: for every place between two turns
a bitset holds, layer by layer of increasing cost, the grammar states from which the end can be reached at just that
cost. A turn shifts the whole set by the cost of each edit at once; layers are added until one accepts, which is the cost.
The audit is then read off the bits from the front: of the edits whose successor is in its layer the ASCII-least is taken.

A conversation is dealt out in chunks of at most CHUNK turns by a range partitioning, so that one with a third of all rows is
the work of many tasks. A chunk knows the least cost between any two states; these 4 x 4 tables are folded from the
last chunk on, each chunk then says where it would end from each state, and one more fold finds where it begins. What is left
to one task is to run through a conversation's repaired text for its one digest, in a stream.

Null roles and texts are one space, as are null ids and turns in the key that deals out damage. A null conv_id is one
conversation. Rows go by turn, nulls first, and, where turns are equal, by role and the digest of the text; equal rows
stand together. An empty role has an empty initial, which no grammar takes. Conversations without rows keep their row, with zeros, an
empty audit and the digest of the empty string. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Turns and characters of a chunk at most; one turn may be longer.
CHUNK, CHUNK_CHARS = 256, 1 << 18
#: Costs of edits; a truncated row that stays costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Grammar states: nothing yet, after s, after u, after a. Bits of a layer.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a row is, in one byte: its initial's code, and from bit 2 on its fault.
INITIALS = {"u": 0, "a": 1, "s": 2}
SOUND, BLANK, DUPLICATE, CUT = range(4)
_SPACES = " \t\n\x0b\x0c\r"
#: The state after a user or assistant turn that is chosen freely, by the state before.
NEXT = (USER, USER, ASSISTANT, USER)
_KEPT = {(START, 0): USER, (SYSTEM, 0): USER, (ASSISTANT, 0): USER, (USER, 1): ASSISTANT, (START, 2): SYSTEM}
Vector = list[int | None]


# ---------------------------------------------------------------- cost layers


def _ones(layers: int) -> int:
    """The lowest bit of each layer."""
    return ((1 << 4 * layers) - 1) // 15


def _by_user(x: int, ones: int) -> int:
    return (x >> USER & ones) * 0b1011


def _by_assistant(x: int, ones: int) -> int:
    return (x >> ASSISTANT & ones) << USER


def _by_system(x: int, ones: int) -> int:
    return x >> SYSTEM & ones


_BY = (_by_user, _by_assistant, _by_system)


def _inserted(x: int, ones: int) -> int:
    """x with the states from which it is reached by inserts; more than three in a row never pay."""
    for _ in range(3):
        x |= (_by_user(x, ones) | _by_assistant(x, ones)) << 4 * INSERT
    return x


def _sets(marks: bytes, end: Vector | None, layers: int) -> list[int]:
    """The layered bitsets at every place, the last one first made. end: costs from there on, by state; None
    for the end of the conversation, where inserts may stand."""
    ones = _ones(layers)
    full = ones * 15
    if end is None:
        x = _inserted(1 << START | 1 << ASSISTANT, ones) & full
    else:
        x = sum(1 << 4 * c + s for s, c in enumerate(end) if c is not None and c < layers)
    sets = [x]
    for mark in reversed(marks):
        initial, fault = mark & 3, mark >> 2
        y = x << 4 * DELETE
        if fault in (SOUND, CUT):
            more = TRUNCATED if fault == CUT else 0
            y |= (_by_user(x, ones) | _by_assistant(x, ones)) << 4 * (REROLE + more)
            if initial < 3:
                y |= _BY[initial](x, ones) << 4 * more
        x = _inserted(y, ones) & full
        sets.append(x)
    sets.reverse()
    return sets


def _first_layer(x: int, state: int, ones: int) -> int | None:
    found = x >> state & ones
    return ((found & -found).bit_length() - 1) // 4 if found else None


def layered(marks: bytes, end: Vector | None, state: int) -> tuple[int, list[int]]:
    """The least cost from state, and the bitsets up to its layer; layers are doubled until one accepts."""
    layers = 16
    while True:
        sets = _sets(marks, end, layers)
        if (cost := _first_layer(sets[0], state, _ones(layers))) is not None:
            return cost, sets
        if layers > 4 * len(marks) + 16 + max([0, *(c for c in end or () if c is not None)]):
            raise ValueError("no edits lead from this state to the end")
        layers *= 2


def _trace(marks: bytes, end: Vector | None, state: int) -> Iterator[tuple[str, int, int]]:
    """(edit, turn, state after it) of the ASCII-least of the cheapest edits."""
    left, sets = layered(marks, end, state)
    has = lambda at, cost, s: cost >= 0 and sets[at] >> 4 * cost + s & 1
    at, n = 0, len(marks)
    while at < n or (end is None and left):
        new = NEXT[state]
        if at < n and has(at + 1, left - DELETE, state):
            left, step = left - DELETE, ("D", at, state)
        elif (at < n or end is None) and has(at, left - INSERT, new):
            left, step = left - INSERT, ("I", at, new)
        else:
            initial, fault = marks[at] & 3, marks[at] >> 2
            more, kept = TRUNCATED if fault == CUT else 0, _KEPT.get((state, initial))
            if kept is not None and has(at + 1, left - more, kept):
                left, step = left - more, ("K", at, kept)
            else:
                left, step = left - more - REROLE, ("R", at, new)
        at += step[0] != "I"
        state = step[2]
        yield step


def crossing(marks: bytes) -> list[Vector]:
    """Least costs by state before and state after the turns; the last row is that to the conversation's end."""
    layers = 4 * len(marks) + 16
    ones, out = _ones(layers), []
    for end in [*([0 if s == t else None for s in range(4)] for t in range(4)), None]:
        x = _sets(marks, end, layers)[0]
        out.append([_first_layer(x, s, ones) for s in range(4)])
    return out


def ends_of(tables: list[list[Vector]]) -> list[Vector | None]:
    """The costs from the end of each chunk on, by state, less their least; None for the last chunk."""
    ends: list[Vector | None] = [None]
    beyond: Vector = []
    for table in reversed(tables):
        if ends[-1] is None:
            beyond = table[4]
        else:
            beyond = [min((c + beyond[t] for t in range(4) if (c := table[t][s]) is not None and beyond[t] is not None), default=None) for s in range(4)]
        least = min(c for c in beyond if c is not None)
        beyond = [None if c is None else c - least for c in beyond]
        ends.append(beyond)
    return ends[-2:0:-1] + [None] if len(ends) > 1 else []


def repaired(marks: bytes, roles: list[str], texts: list[str], end: Vector | None, state: int) -> tuple[str, list[str]]:
    """The audit and the rows that stand after it."""
    audit, rows = [], []
    for edit, at, new in _trace(marks, end, state):
        audit.append(edit)
        free = "user" if new == USER else "assistant"
        if edit == "K":
            rows.append(f"{roles[at]}:{texts[at]}")
        elif edit != "D":
            rows.append(f"{free}:{texts[at] if edit == 'R' else ''}")
    return "".join(audit), rows


# ---------------------------------------------------------------- rows to chunks


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows after damage, which the key of a row decides."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("fault") == 3, 2).otherwise(1)
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    rows = rows.where("fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy"))
    return rows.drop("copy")


def _place() -> Column:
    return F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))


def _faults(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows with digest, last (the last character that is no white space) and again (said in an earlier turn)."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min(_place()).alias("first"), F.count("*").alias("said")).where("said > 1")
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    met = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    last = F.right(F.rtrim("text", F.lit(_SPACES)), F.lit(1))
    return scratch.write(met.select("conv_id", "turn", "role", "text", "digest", last.alias("last"), F.coalesce(_place() > F.col("first"), F.lit(False)).alias("again")), "faults")


_CHUNK = "conv_id long, chunk long, marks binary, costs array<array<int>>, firsts string, lasts string, low long, high long, turns long, roles array<string>, texts array<string>"


def _rows_of(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b[n].to_pylist() for n in names), strict=True)


def _chunk(number: int, conv, rows: list[tuple], marks: bytearray) -> tuple:
    turns = [r[1] for r in rows if r[1] is not None]
    roles = [r[2] for r in rows]
    return (conv, number, bytes(marks), crossing(bytes(marks)), roles[0][:1], roles[-1][:1], min(turns, default=None), max(turns, default=None), len(set(turns)), roles, [r[3] for r in rows])


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    base, number, out = TaskContext.get().partitionId() << 32, 0, []
    before, open_rows, marks, chars = object(), [], bytearray(), 0
    schema = _arrow(_CHUNK)
    for conv, turn, role, text, digest, last, again in _rows_of(batches, "conv_id", "turn", "role", "text", "digest", "last", "again"):
        if open_rows and (conv != open_rows[0][0] or len(open_rows) >= most or chars >= CHUNK_CHARS):
            out.append(_chunk(base + number, open_rows[0][0], open_rows, marks))
            number, open_rows, marks, chars = number + 1, [], bytearray(), 0
            if len(out) >= 200:
                yield _batch(out, schema)
                out = []
        this = (conv, turn, role, digest)
        fault = BLANK if not last else DUPLICATE if again or this == before else SOUND if last in ".!?" else CUT
        before = this
        open_rows.append((conv, turn, role, text))
        marks.append(INITIALS.get(role[:1], 3) | fault << 2)
        chars += len(text)
    if open_rows:
        out.append(_chunk(base + number, open_rows[0][0], open_rows, marks))
    if out:
        yield _batch(out, schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<array<int>>": pa.list_(pa.list_(pa.int32())), "array<string>": pa.list_(pa.string())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


# ---------------------------------------------------------------- chunks of one conversation

_ENDS = "chunk long, marks binary, end array<int>, first int"
_EXITS = "conv_id long, chunk long, exits array<int>, end array<int>"
_ENTRIES = "chunk long, state int, end array<int>"


def _fold_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted(_rows_of(batches, "conv_id", "chunk", "marks", "costs"), key=lambda r: r[1])
    ends, schema = ends_of([r[3] for r in rows]), _arrow("conv_id long, chunk long, marks binary, end array<int>")
    for at in range(0, len(rows), 1000):
        yield _batch([(r[0], r[1], r[2], e) for r, e in zip(rows[at : at + 1000], ends[at : at + 1000], strict=True)], schema)


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each chunk would end, by the state in which it begins."""
    schema = _arrow(_EXITS)
    for b in batches:
        out = []
        for conv, chunk, marks, end in _rows_of([b], "conv_id", "chunk", "marks", "end"):
            exits = []
            for state in range(4):
                try:
                    for _, _, new in _trace(marks, end, s := state):
                        s = new
                except ValueError:  # nothing leads from here
                    s = -1
                exits.append(s)
            out.append((conv, chunk, exits, end))
        if out:
            yield _batch(out, schema)


def _fold_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state, schema, out = START, _arrow(_ENTRIES), []
    for chunk, exits, end in sorted(_rows_of(batches, "chunk", "exits", "end"), key=lambda r: r[0]):
        out.append((chunk, state, end))
        state = exits[state]
    for at in range(0, len(out), 1000):
        yield _batch(out[at : at + 1000], schema)


def _entries(chunks: DataFrame) -> DataFrame:
    """The state in which each chunk of a conversation of several begins, and the costs beyond it."""
    heads = chunks.select("conv_id", "chunk", "marks", "costs", F.count("*").over(Window.partitionBy("conv_id")).alias("n")).where("n > 1")
    ends = heads.drop("n").groupBy("conv_id").applyInArrow(_fold_ends, "conv_id long, chunk long, marks binary, end array<int>")
    exits = ends.repartition("chunk").mapInArrow(_exits, _EXITS)
    return exits.groupBy("conv_id").applyInArrow(_fold_entries, _ENTRIES)


# ---------------------------------------------------------------- results

_PIECE = "conv_id long, chunk long, marks binary, firsts string, lasts string, low long, high long, turns long, audit string, rows array<string>"
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _arrow(_PIECE)
    names = [f.name for f in schema][:8]
    for b in batches:
        out = []
        for *head, roles, texts, end, state in _rows_of([b], *names, "roles", "texts", "end", "state"):
            out.append((*head, *repaired(head[2], roles, texts, end, state or START)))
        if out:
            yield _batch(out, schema)


def _illegal(pairs: Iterable[tuple[str, str]]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in pairs)


def cost_of(audit: str, marks: bytes) -> int:
    """What the edits cost."""
    total, at = 0, 0
    for edit in audit:
        if edit == "I":
            total += INSERT
            continue
        total += DELETE if edit == "D" else REROLE * (edit == "R") + TRUNCATED * (marks[at] >> 2 == CUT)
        at += 1
    return total


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation; its chunks come one after the other."""
    schema, out = _arrow(RESULT), []
    names = [c.split()[0] for c in _PIECE.split(", ")]
    for conv, chunks in groupby(_rows_of(batches, *names), key=lambda r: r[0]):
        faults, illegal, cost, audit, digest = [0] * 4, 0, 0, [], hashlib.sha256()
        lows, high, turns, last, any_row = [], None, 0, None, False
        for _, _, marks, first, end, low, top, n, edits, rows in chunks:
            for m in marks:
                faults[m >> 2] += 1
            names_of = ["uas"[m & 3] if m & 3 < 3 else "?" for m in marks]
            illegal += _illegal(zip(names_of, names_of[1:], strict=False)) + (last is not None and _illegal([(last, first)]))
            last, cost = end, cost + cost_of(edits, marks)
            audit.append(edits)
            for row in rows:
                digest.update(("\n" + row if any_row else row).encode("utf-8", "surrogatepass"))
                any_row = True
            if low is not None:
                lows.append(low)
                turns += n - (high == low)  # a turn may lie on both sides of a cut
                high = top
        gaps = high - lows[0] + 1 - turns if lows else 0
        out.append((conv, gaps, faults[BLANK], faults[DUPLICATE], faults[CUT], illegal, cost, "".join(audit), digest.hexdigest()))
        if len(out) >= 500:
            yield _batch(out, schema)
            out = []
    if out:
        yield _batch(out, schema)


def repair(turns: DataFrame, conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """RESULT of the rows of turns: one row for each conv_id of conversations. chunk: turns of a chunk at most."""
    scratch = Scratch(turns.sparkSession, "repair")
    order = ["conv_id", "turn", "role", "digest"]
    dealt = _faults(turns, scratch).repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = scratch.write(dealt.mapInArrow(partial(_chunks, most=chunk), _CHUNK), "chunks")
    pieces = chunks.join(_entries(chunks), "chunk", "left").mapInArrow(_pieces, _PIECE)
    found = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(_joined, RESULT)
    known = conversations.select(F.col("conv_id").cast("long").alias("known")).distinct()
    joined = known.join(found, F.col("known").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(F.col("known").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
