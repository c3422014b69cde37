import json

from pyspark.sql import functions as F

from cuelattice.sources import readers, sinks
from cuelattice.streaming import islands as stream


def test_transcripts_take_defaults(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"words": [{"text": "hi", "start": 0.5, "end": 0.75}, {"text": "you", "start": 1, "end": 1.2, "speaker": "S1", "score": 0.4}]}))
    got = readers.read_transcripts(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.text, r.s, r.e, r.speaker, r.score, r.source, r.language) for r in got] == [("hi", 500_000, 750_000, "", None, "heard", ""), ("you", 1_000_000, 1_200_000, "S1", 0.4, "heard", "")]


def test_replies_are_repaired_or_dropped(spark):
    reply = json.dumps([{"start": 1.0, "end": 2.0, "text": "ok"}, {"start": 3.0, "text": "no end at all"}, {"start": 5, "end": 4, "text": "x"}, {"end": 1, "text": "no start"}, {"start": 1, "end": 2, "text": " "}])
    d = spark.createDataFrame([(1, reply), (2, "not json"), (3, None)], "clip long, reply string")
    got = readers.parse_replies(d).orderBy("s").collect()
    assert [(r.clip, r.s, r.e) for r in got] == [(1, 1_000_000, 2_000_000), (1, 3_000_000, 3_910_000), (1, 5_000_000, 5_300_000)]


def test_scripts(spark):
    d = spark.createDataFrame([("A +0.5: hello there",), ("B -1: no",), ("nothing",)], "line string")
    assert [tuple(r) for r in readers.parse_script(d).collect()] == [("A", 0.5, False, "hello there"), ("B", 1.0, True, "no")]


def test_unfolded(spark):
    inner = json.dumps({"text": "short"})
    d = spark.createDataFrame([(json.dumps({"text": inner}),), (inner,)], "body string")
    assert {r.body for r in readers.unfolded(d, "body", "text").collect()} == {inner}


def test_files_and_kept_transcripts(spark, tmp_path):
    cues = spark.createDataFrame([(1, 1, "a <b>c</b>", 0, 1000), (1, 2, "x || y", 2000, 4000), (1, 3, " ", 5000, 6000)], "key long, number long, text string, start_ms long, end_ms long")
    sinks.write_srt(cues, ["key"], str(tmp_path / "srt"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "srt/key=1")).collect())
    assert text.startswith("1\n00:00:00,000 --> 00:00:01,000\na c") and "2\n00:00:02,000 --> 00:00:03,000\n- x" in text and "3\n00:00:03,000 --> 00:00:04,000\n- x\n- y" in text
    sinks.keep_transcript(cues, "k1", str(tmp_path / "kept"))
    sinks.keep_transcript(cues.limit(1), "k2", str(tmp_path / "kept"))
    assert sinks.kept_transcript(spark, "k1", str(tmp_path / "kept")).count() == 3 and sinks.kept_transcript(spark, "none", str(tmp_path / "kept")) is None
    doubts = spark.createDataFrame([(1, 2, "weak"), (1, 2, "alone")], "key long, number long, kind string")
    got = {r.number: json.loads(r.review) for r in sinks.review_rows(cues, doubts, ["key"]).collect()}
    assert got[2]["doubts"] == ["alone", "weak"] and got[2]["start"] == 2.0 and got[1]["doubts"] == []


def test_streamed_islands_are_those_of_the_batch(spark, tmp_path):
    day = 86_400_000_000
    rows = [(k, day + t * 1_000_000, day + t * 1_000_000 + 500_000) for k in (1, 2) for t in (0, 1, 2, 100, 101, 7200)]
    d = spark.createDataFrame(rows, "key long, s long, e long").withColumn("ts", F.timestamp_micros("s"))
    d.orderBy("s").coalesce(1).write.parquet(str(tmp_path / "in"))
    # a last row far ahead moves the watermark past all islands before it
    spark.createDataFrame([(3, day + 90_000_000_000, day + 90_000_000_001)], "key long, s long, e long").withColumn("ts", F.timestamp_micros("s")).write.mode("append").parquet(str(tmp_path / "in2"))
    events = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    q = stream.stream_islands(events, 10_000_000).writeStream.format("memory").queryName("islands").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.key, r.s, r.e, r.n) for r in spark.table("islands").collect())
    want = [(k, day + a * 1_000_000, day + b * 1_000_000 + 500_000, n) for k in (1, 2) for a, b, n in ((0, 2, 3), (100, 101, 2), (7200, 7200, 1))]
    assert got == want
