"""What each filter removes in every order of filters, and its Shapley share.

Every document is read once and becomes a mask of the filters that it fails; per part the masks are counted in cells
(32 of them for five filters). The orders are then visited by swaps of neighbours: a swap changes two steps only, and both
are read from the cells. A filter's removals are summed along the walk: what it removed is added, times the orders for which
that stood, when a swap changes it.

Null texts are empty and null sources are the empty part. An equal text fails E where a smaller doc_id has it anywhere in
the table; a row without doc_id neither fails E nor makes another fail. Repeated rows of one doc_id count each, and
are no copies of each other. A document is good (toxic) if any row of labels says so. No documents, no rows. Other columns of
both tables are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: The filters, by bit of the mask.
FILTERS = "ABCDE"
#: Bytes of a text whose words are split at once.
BLOCK = 1 << 20
#: Parts whose rows are made at once; each has 600.
PARTS = 64
_SIGNS = b"#$%&*|"
_CAPITALS = bytes(range(65, 91))
_MEASURED = "doc_id long, part string, mask int, digest binary"
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def word_counts(raw: bytes) -> tuple[int, int]:
    """Words and distinct words of a text, which is split block by block."""
    seen, n, rest = set(), 0, b""
    for at in range(0, len(raw), BLOCK):
        block = rest + raw[at : at + BLOCK]
        words = block.split()
        rest = b"" if not words or block[-1:].isspace() else words.pop()
        n += len(words)
        seen.update(words)
    return n + bool(rest), len(seen | {rest}) if rest else len(seen)


def own_faults(raw: bytes, points: int) -> int:
    """The mask of the filters A to D that a text of so many code points fails."""
    n, distinct = word_counts(raw)
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    signs = len(raw) != len(raw.translate(None, _SIGNS))
    return (n < 200) | (100 * distinct < 50 * n) << 1 | (100 * capitals > 2 * points) << 2 | signs << 3


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        masks, digests = [], []
        points = pc.utf8_length(b["text"]).to_pylist()
        for text, n in zip(b["text"], points, strict=True):
            raw = bytes(text.as_buffer())
            masks.append(own_faults(raw, n))
            digests.append(hashlib.sha256(raw).digest())
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["part"], pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])


def cells(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """part, mask, n, good, toxic: the documents of every part by the filters that they fail."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    measured = scratch.write(texts.mapInArrow(_measure, _MEASURED), "measured")
    # the first row of a text is met by text and id: a key that no group of copies makes hot
    firsts = measured.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    said = said.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    marked = measured.join(firsts, ["digest", "doc_id"], "left").join(said, "doc_id", "left")
    marked = marked.select("part", F.when(copy, F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"), "good", "toxic")
    return marked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def swaps(n: int) -> list[int]:
    """Places whose neighbours are swapped, one by one, so that all orders of n things come once: the last one
    sweeps through the others, which move by one of their own swaps between two sweeps."""
    if n < 2:
        return []
    inner, out = swaps(n - 1), []
    for i in range(len(inner) + 1):
        out += range(n - 1) if i % 2 else range(n - 2, -1, -1)
        if i < len(inner):
            out.append(inner[i] + (i % 2 == 0))  # the last one rests in front after every even sweep
    return out


class Walk:
    """The orders of the filters over the cells of some parts: counts is parts x masks x (all, good, toxic)."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.n = counts, len(FILTERS)
        self.order = list(range(self.n))
        masks = np.arange(1 << self.n)
        self.fails = [counts[:, (masks >> f & 1) == 1, 0].sum(1) for f in range(self.n)]
        self.alone = [counts[:, 1 << f, 0] for f in range(self.n)]
        self._masks, self._read = masks, {}
        self.lost, self.kept = [None] * self.n, [None] * self.n
        self.shapley, self._since = np.zeros((self.n, len(counts)), np.int64), [0] * self.n
        self.visited = 0
        before, left = 0, counts[:, :, 0].sum(1)
        for at, f in enumerate(self.order):
            self.lost[f] = self._removed(f, before)
            left = left - self.lost[f][:, 0]
            self.kept[at] = left
            before |= 1 << f

    def _removed(self, f: int, before: int) -> np.ndarray:
        """Parts x (all, good, toxic) that fail f and none of the filters before it."""
        if (f, before) not in self._read:
            here = (self._masks >> f & 1 == 1) & (self._masks & before == 0)
            self._read[f, before] = self.counts[:, here].sum(1)
        return self._read[f, before]

    def _settle(self, f: int) -> None:
        self.shapley[f] += self.lost[f][:, 0] * (self.visited - self._since[f])
        self._since[f] = self.visited

    def swap(self, at: int) -> None:
        """The next order: the filters at and at + 1 change places; only these two steps change."""
        a, b = self.order[at], self.order[at + 1]
        self.visited += 1
        self._settle(a)
        self._settle(b)
        before = sum(1 << f for f in self.order[:at])
        left = self.kept[at + 1] + self.lost[a][:, 0] + self.lost[b][:, 0]
        self.lost[b], self.lost[a] = self._removed(b, before), self._removed(a, before | 1 << b)
        self.order[at], self.order[at + 1] = b, a
        self.kept[at] = left - self.lost[b][:, 0]

    def orders(self) -> Iterator[list[int]]:
        """Every order once; shapley is whole at the end."""
        yield self.order
        for at in swaps(self.n):
            self.swap(at)
            yield self.order
        self.visited += 1
        for f in range(self.n):
            self._settle(f)


def _rows(parts: list[str], counts: np.ndarray) -> pa.RecordBatch:
    walk, names, places, filters, columns = Walk(counts), [], [], [], [[] for _ in range(6)]
    for order in walk.orders():
        name = "".join(FILTERS[f] for f in order)
        for at, f in enumerate(order):
            lost = walk.lost[f]
            names.append(name)
            places.append(at + 1)
            filters.append(f)
            for column, values in zip(columns, (walk.kept[at], lost[:, 0], walk.fails[f] - lost[:, 0], walk.alone[f], lost[:, 1], lost[:, 2]), strict=True):
                column.append(values)
    of = lambda rows: pa.array(np.asarray(rows, np.int64).ravel(), pa.int64())
    each = len(parts)
    arrays = [pa.array(parts * len(names)), pa.array(np.repeat(names, each)), pa.array(np.repeat(places, each), pa.int32()), *map(of, columns), of(walk.shapley[filters])]
    return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in RESULT.split(", ")])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, PARTS):
            rows = b.slice(at, PARTS).to_pylist()
            counts = np.zeros((len(rows), 1 << len(FILTERS), 3), np.int64)
            for i, r in enumerate(rows):
                for c in r["cells"]:
                    counts[i, c["mask"]] = c["n"], c["good"], c["toxic"]
            yield _rows([r["part"] for r in rows], counts)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """RESULT: one row per part, order of the filters and step."""
    found = cells(docs, labels, Scratch(docs.sparkSession, "audit"))
    by_part = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return by_part.mapInArrow(_walk, RESULT)


AUDIT_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), said AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), failing AS (
  SELECT doc_id, part,
    (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask
  FROM docs
), cell AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM failing LEFT JOIN said USING (doc_id) GROUP BY part, mask
), filter AS (SELECT unnest(range(5)) AS f), orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS fs FROM filter a, filter b, filter c, filter d, filter e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT array_to_string(list_transform(fs, lambda f: chr(65 + f::INT)), '') AS filter_order, s::INT AS step, fs[s] AS f,
    coalesce(list_sum(list_transform(fs[1:s - 1], lambda f: 1 << f::INT)), 0)::INT AS before
  FROM orders, unnest(range(1, 6)) AS t(s)
), counted AS (
  SELECT part, filter_order, step, f,
    sum(n) FILTER (mask & (before | (1 << f::INT)) = 0) AS kept,
    sum(n) FILTER (mask >> f::INT & 1 = 1 AND mask & before = 0) AS removed,
    sum(n) FILTER (mask >> f::INT & 1 = 1 AND mask & before <> 0) AS redundant,
    sum(n) FILTER (mask = 1 << f::INT) AS unique_fails,
    sum(good) FILTER (mask >> f::INT & 1 = 1 AND mask & before = 0) AS good_lost,
    sum(toxic) FILTER (mask >> f::INT & 1 = 1 AND mask & before = 0) AS toxic_lost
  FROM steps, cell GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""
