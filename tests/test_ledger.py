"""What the ledger decides, and that a stream that is restarted decides as the batch does."""

import random

from cuelattice.streaming import ledger as le

S = 1_000_000
ASKS = "key long, seq long, job long, s long, e long, outcome string"


def _decided(*asks, **rules):
    book, r = le.Book(), le.Rules(**rules)
    return [book.ask(job, s * S, e * S, outcome, r) for job, s, e, outcome in asks]


def test_what_is_known_is_not_asked_again():
    assert _decided((1, 10, 20, "answered"), (1, 11, 19, "answered"), (1, 30, 40, "answered"), (2, 11, 19, "answered")) == ["asked", "known", "asked", "asked"]


def test_a_stretch_is_answered_in_two_jobs_at_most():
    asks = [(job, 10, 20, "answered") for job in (1, 2, 3)]
    assert _decided(*asks) == ["asked", "asked", "spent"]
    # a failed request is no try, and more sound beside a stretch of this job neither
    assert _decided((1, 10, 20, "failed"), (2, 10, 20, "answered"), (3, 10, 20, "answered"), (4, 10, 20, "answered")) == ["failed", "asked", "asked", "spent"]
    assert _decided((1, 10, 20, "answered"), (1, 9, 23, "answered"), (2, 10, 20, "answered"), (2, 9, 23, "answered"), (3, 10, 20, "answered")) == ["asked", "asked", "asked", "asked", "spent"]


def test_failed_sound_and_used_up_quota():
    assert _decided((1, 10, 20, "failed"), (1, 12, 18, "answered"), (1, 50, 60, "answered"), (2, 12, 18, "answered")) == ["failed", "refused", "asked", "asked"]
    assert _decided((1, 10, 20, "quota"), (1, 50, 60, "answered"), (2, 50, 60, "answered")) == ["failed", "refused", "asked"]


def test_a_job_asks_within_its_budget():
    assert _decided((1, 0, 10, "answered"), (1, 20, 30, "answered"), (1, 40, 41, "answered"), (2, 20, 30, "answered"), budget=15 * S) == ["asked", "over", "asked", "asked"]


def test_a_restarted_stream_equals_the_batch(spark, tmp_path):
    r = random.Random(3)
    rows = [(k, seq, seq // 25, s := r.randrange(0, 90) * S, s + r.randrange(1, 12) * S, r.choice(["answered"] * 5 + ["failed", "quota"])) for seq in range(120) for k in [r.randrange(4)]]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    whole = spark.createDataFrame(rows, ASKS)
    rules = le.Rules(budget=60 * S)
    for k in range(3):  # each part is a run of its own, from where the last one stopped
        spark.createDataFrame(rows[40 * k : 40 * (k + 1)], ASKS).coalesce(1).write.mode("append").parquet(source)
        stream = le.stream_ledger(spark.readStream.schema(ASKS).parquet(source), rules=rules)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(x) for x in spark.read.parquet(out).collect())
    want = sorted(tuple(x) for x in le.ledger(whole, ["key"], rules).collect())
    assert got == want and len({d for *_, d in want}) >= 5
