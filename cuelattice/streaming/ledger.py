"""A ledger of stretches of sound that were asked about again: what is known is not asked, nor what was tried too often.

The ledger of a key is state that Spark keeps: a value (the job at hand, what it may still spend) and two lists (stretches with
their tries over all jobs; stretches answered or failed in this job). The batch form folds the same requests in their order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What becomes of a request: known (inside sound that was answered in this job), spent (answered too often in other jobs), refused (no
#: quota left in this job, or inside sound that failed in it), over (the job's budget does not reach), failed, asked.
DECISIONS = ("known", "spent", "refused", "over", "failed", "asked")
ANSWERED, FAILED = 1, 2


@dataclass(frozen=True)
class Rules:
    """Microseconds: pad is heard on either side of a stretch, budget may be asked about in a job. share: of the shorter of two stretches, so that they are the same one."""

    tries: int = 2
    pad: int = 750_000
    budget: int = 600_000_000
    share: float = 0.5


@dataclass
class Book:
    """The ledger of one key."""

    job: int | None = None
    left: int = 0
    quota: bool = True
    tries: list[list[int]] = field(default_factory=list)  # start, end, jobs that were answered
    sound: list[tuple[int, int, int]] = field(default_factory=list)  # start, end, ANSWERED or FAILED, in this job

    def ask(self, job: int, start: int, end: int, outcome: str, r: Rules) -> str:
        """The decision on one request; outcome is what the listener says if it is asked: answered, failed or quota."""
        if job != self.job:
            self.job, self.left, self.quota, self.sound = job, r.budget, True, []
        held = {kind for a, b, kind in self.sound if a <= start and end <= b}
        if ANSWERED in held:
            return "known"
        low, high = max(0, start - r.pad), end + r.pad
        alike = lambda a, b: min(b, high) - max(a, low) >= r.share * min(b - a, high - low)
        before = next((t for t in self.tries if alike(t[0], t[1])), None)
        again = any(kind == ANSWERED and alike(a, b) for a, b, kind in self.sound)
        if before is not None and before[2] >= r.tries and not again:
            return "spent"
        if not self.quota or FAILED in held:
            return "refused"
        if high - low > self.left:
            return "over"
        self.left -= high - low
        if outcome != "answered":
            self.quota = self.quota and outcome != "quota"
            self.sound.append((low, high, FAILED))
            return "failed"
        self.sound.append((low, high, ANSWERED))
        if not again:  # more sound beside a stretch of this job is no new try
            if before is None:
                self.tries.append([low, high, 1])
            else:
                before[2] += 1
        return "asked"

    def all(self, rows: pd.DataFrame, r: Rules) -> list[str]:
        return [self.ask(*map(int, x[:3]), x[3], r) for x in rows[["job", "s", "e", "outcome"]].itertuples(index=False, name=None)]


def ledger(requests: DataFrame, keys: Sequence[str], rules: Rules = Rules()) -> DataFrame:
    """keys, seq, decision of requests (seq, job, s, e, outcome), each key's in the order of seq; jobs follow each other."""
    kinds = dict(requests.dtypes)

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq")
        return part[[*keys, "seq"]].assign(decision=Book().all(part, rules))

    return requests.groupBy(*keys).applyInPandas(fold, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"seq {kinds['seq']}, decision string"]))


class _Processor(StatefulProcessor):
    def __init__(self, key: str, rules: Rules):
        self.key, self.rules = key, rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.job = handle.getValueState("job", "job long, budget long, quota boolean")
        self.tries = handle.getListState("tries", "s long, e long, n long")
        self.sound = handle.getListState("sound", "s long, e long, kind int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        part = pd.concat(rows).sort_values("seq")
        book = Book(tries=[list(map(int, t)) for t in self.tries.get()], sound=[tuple(map(int, x)) for x in self.sound.get()])
        if self.job.exists():
            job, left, quota = self.job.get()
            book.job, book.left, book.quota = int(job), int(left), bool(quota)
        decisions = book.all(part, self.rules)
        self.job.update((book.job, book.left, book.quota))
        for state, held in ((self.tries, book.tries), (self.sound, book.sound)):
            if held:
                state.put([tuple(x) for x in held])
            else:
                state.clear()
        yield part[[self.key, "seq"]].assign(decision=decisions)

    def close(self) -> None:
        pass


def stream_ledger(requests: DataFrame, key: str = "key", rules: Rules = Rules()) -> DataFrame:
    """key, seq, decision of a stream of requests, which come in the order of seq. Needs Spark's state store on RocksDB.

    A job's stretches are dropped with the next job, so a key's state is bounded by its stretches of sound.
    """
    kinds = dict(requests.dtypes)
    return requests.groupBy(key).transformWithStateInPandas(_Processor(key, rules), f"`{key}` {kinds[key]}, seq {kinds['seq']}, decision string", "append", "none")
