import hashlib
import random

from pyspark.sql import functions as F

from cuelattice.llm.chat import TRICKY, format_chats, read_back

TURNS = "conv_id long, turn long, role string, text string"
BITS = ["### ", "</turn>", "\\", "\n", "user", ": ", "Assistant", "### assistant: ", "\n</turn>\n", "x", "é", "#", "<", "\\### ", "$1", "\\s"]


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_reads_back_what_went_in(spark):
    r = random.Random(3)
    rows = list(TRICKY)
    for conv in range(60):
        for turn in range(r.randrange(1, 9)):
            role = r.choice(["user", "assistant", "system", "tool: x\n", "a\\b", ""])
            rows.append((conv, turn, role, "".join(r.choice(BITS) for _ in range(r.randrange(12)))))
    examples = format_chats(spark.createDataFrame(rows, TURNS)).cache()
    got = {x.conv_id: x for x in read_back(examples).collect()}
    for conv in {x[0] for x in rows}:
        turns = [(x[2], x[3]) for x in rows if x[0] == conv]
        loss = "".join(t for role, t in turns if role == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(turns), _sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (g.loss_chars, g.loss_sha256) == (len(loss), _sha(loss))
    # an example for each assistant turn, and one for what stands behind the last
    n = sum(x[2] == "assistant" for x in rows)
    assert examples.where("loss_chars > 0 or last").count() <= examples.count()
    assert examples.groupBy("conv_id").agg(F.count_if("last").alias("n")).where("n <> 1").count() == 0
    assert examples.count() - n == sum(max((x for x in rows if x[0] == c), key=lambda x: x[1])[2] != "assistant" for c in {x[0] for x in rows})


def test_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", None), (None, None, None, None), (2, 5, "assistant", "b"), (2, 5, "assistant", "a"), (2, 5, "assistant", "a"), (3, 0, "assistant", "long " * 50_000)]
    d = spark.createDataFrame(rows, TURNS).withColumn("formatted", F.lit("clash")).withColumn("last", F.lit("clash"))
    got = {x.conv_id: x for x in read_back(format_chats(d)).collect()}
    assert got[1].n_turns == 2 and got[1].loss_chars == 0
    assert got[None].n_turns == 1 and got[None].loss_sha256 == _sha("")
    assert got[2].loss_sha256 == _sha("aab") and got[2].n_examples == 3
    assert got[3].loss_chars == 250_000
    assert read_back(format_chats(spark.createDataFrame([], TURNS))).count() == 0


def test_no_python_in_the_plan(spark):
    d = spark.createDataFrame([], TURNS)
    plan = read_back(format_chats(d))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
