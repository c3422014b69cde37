"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One white-space-delimited word, as the contracts of the queries define it.
WORD = r"[^\x20\x09-\x0D]+"
#: Broadcast only what has been counted and found below this many bytes.
BROADCAST_BYTES = 32 * 1024 * 1024


#: Rows of an Arrow batch at most: texts can be long, and a batch is held by the JVM and by Python at once.
ARROW_ROWS = 500
_ARROW_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ARROW_ROWS; a smaller setting stays."""
    if not 0 < int(spark.conf.get(_ARROW_SETTING, "10000")) <= ARROW_ROWS:
        spark.conf.set(_ARROW_SETTING, ARROW_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_folder() -> str:
    """One temporary folder for local sessions that name none."""
    return tempfile.mkdtemp(prefix="spark-checkpoints-")


def _shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a session of one local process that sets none gets a temporary folder."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: executors need a shared folder for written tables")
    return _own_folder()


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each with so many underscores before it that no taken one is equal, whatever its case."""
    known, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in known:
            name = f"_{name}"
        known.add(name.lower())
        out.append(name)
    return out


class Scratch:
    """Written tables that cut lineage, in the folder that the cluster shares."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        bounded_batches(spark)
        self.path = f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and return the written table."""
        self.n += 1
        path = f"{self.path}/{self.n:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if its counted rows fit the bound; else df as it is, for a shuffle join."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


# ---------------------------------------------------------------- hashing of words

_rng = np.random.default_rng(20240229)
_BYTES = _rng.integers(0, 2**64, 256, dtype=np.uint64)
# A-Z are hashed as a-z
_BYTES[65:91] = _BYTES[97:123]
_STEP = 0x9E3779B97F4A7C15
#: Bytes of a text, and hashes, that are worked on at once.
BLOCK = 1 << 18


def _powers(base: int) -> np.ndarray:
    steps = np.full(BLOCK + 1, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


@cache
def _up_down() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse, modulo 2**64."""
    return _powers(_STEP), _powers(pow(_STEP, -1, 2**64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Bytes between terms: ASCII characters other than letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def as_bytes(text: str | pa.Scalar | np.ndarray | None) -> np.ndarray:
    """The text's UTF-8 bytes; those of an Arrow value are not copied. Null has none."""
    if isinstance(text, np.ndarray):
        return text
    if isinstance(text, pa.Scalar):
        text = text.as_buffer() if text.is_valid else None
    elif text is not None:
        text = text.encode("utf-8", "surrogatepass")
    return np.frombuffer(text, np.uint8) if text is not None and len(text) else np.empty(0, np.uint8)


def run_blocks(raw: np.ndarray, gaps: np.ndarray = SPACE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """64-bit hashes, starts and ends of the runs of raw's bytes that are not in gaps, block by block.

    A run that goes on in the next block is carried there, so that memory is bounded by the block and its runs.
    """
    up, down = _up_down()
    begun, carried, size = -1, 0, 0
    for at in range(0, len(raw), BLOCK):
        block = raw[at : at + BLOCK]
        n = len(block)
        gap = gaps[block]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
        start, end = edge[0::2], edge[1::2]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[block] * up[:n], dtype=np.uint64)))
        sums, length, first = (total[end] - total[start]) * down[start], end - start, start + at
        if begun >= 0:
            if len(start) and start[0] == 0:
                more = int(sums[0]) * pow(_STEP, size, 2**64)
                sums[0], length[0], first[0] = (carried + more) % 2**64, length[0] + size, begun
            else:  # it ended with the block before
                sums, length, first, end = np.append(np.uint64(carried), sums), np.append(size, length), np.append(begun, first), np.append(0, end)
            begun = -1
        if len(end) and end[-1] == n and at + n < len(raw):
            begun, carried, size = int(first[-1]), int(sums[-1]), int(length[-1])
            sums, length, first = sums[:-1], length[:-1], first[:-1]
        yield mix64(sums + length.astype(np.uint64)), first, first + length


def word_hashes(text) -> np.ndarray:
    """64-bit hashes of the words of the text, A-Z lower-cased, in order."""
    parts = [h for h, _, _ in run_blocks(as_bytes(text))]
    return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.uint64), *parts])


def term_blocks(text) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes, byte starts and byte ends of the runs of letters and digits of the text, A-Z lower-cased."""
    return run_blocks(as_bytes(text), PUNCTUATION)


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of each run of width words; of the whole sequence if it is shorter; none without words."""
    n = len(words)
    width = min(width, n)
    if not n:
        return words
    out = np.empty(n - width + 1, np.uint64)
    for at in range(0, len(out), BLOCK):
        part = words[at : min(at + BLOCK, len(out))].copy()
        for i in range(1, width):
            part *= np.uint64(0xD6E8FEB86659FD93)
            part += words[at + i : at + i + len(part)]
        out[at : at + len(part)] = mix64(part + np.uint64(width))
    return out


def shingle_set(text, width: int = 5) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    s = shingle_hashes(word_hashes(text), width)
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s


def digest128(values: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit numbers that stand for the array."""
    d = xxhash.xxh3_128_digest(np.ascontiguousarray(values))
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
