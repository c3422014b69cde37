import re

from pyspark.sql import functions as F

from cuelattice.functions import shapes, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


def test_words_and_tokens(spark):
    assert one(spark, "Hey,  Ann's ½ été ___\n", text.tokens) == ["hey", "ann's", "½", "été", "___"]
    assert one(spark, "", text.tokens) == [] and one(spark, "a b c d", lambda c: text.grams(text.tokens(c), 3)) == ["a b c", "b c d"]
    assert one(spark, "a b", lambda c: text.grams(text.tokens(c), 3)) == []


def test_unspaced_scripts(spark):
    assert one(spark, "你好 world 日本", text.split_words) == ["你", "好", "world", "日", "本"]
    assert one(spark, ["你", "好", "world", "日"], text.joined_words, "array<string>") == "你好 world 日"
    assert one(spark, "你好世界 a b", text.counted) == 3.0


def test_numbers(spark):
    assert one(spark, "in 1,234 or ١٢ of 500, 7 and 1999", text.numbers) == ["1234", "12", "1999"]
    assert one(spark, "what?!  ٣ so?? no!؟", text.normalise) == "what؟ 3 so?? no؟"
    assert one(spark, "what?! ٣", lambda c: text.normalise(c, arabic=False)) == "what? ٣"


def test_sounds(spark):
    for value, want in {"Ummmm... haha!": True, "oh no": False, "": False, "Hahahaha": True, "ohhh": True, "er": False, "wow": False, "Mm-hmm": True, "آههه": True, "хахаха": True, "嗯": True, "うーん": True, "नहीं": False, "음...": True, "No": False}.items():
        assert one(spark, value, text.only_a_sound) is want, value


def test_labels(spark):
    assert one(spark, "p2.S1~k3", text.speaker) == "S1~k3"
    assert one(spark, "S1~k3", text.unlinked) and not one(spark, "S1", text.unlinked)
    assert one(spark, ["S1", "S3"], lambda c: text.first_free("S", c), "array<string>") == "S2"


def test_times(spark):
    assert one(spark, 3661.0005, lambda c: shapes.srt_time(shapes.milliseconds(c)), "double") == "01:01:01,000"
    assert one(spark, 0.0015, lambda c: shapes.srt_time(shapes.milliseconds(c)), "double") == "00:00:00,002"
    assert one(spark, -1.0, lambda c: shapes.ass_time(shapes.milliseconds(c)), "double") == "0:00:00.00"
    assert one(spark, 109.5, shapes.read_back, "double") == 69.5 and one(spark, 175.0, shapes.read_back, "double") is None


def test_colours(spark):
    assert round(one(spark, "#ffffff", lambda c: shapes.contrast(c, F.lit("#000000"))), 2) == 21.0
    assert one(spark, "#102030", lambda c: shapes.ass_colour(c, F.lit(1.0))) == "&H00302010"


def test_run_lengths(spark):
    v = [1, 1, 0, 2, 2, 2]
    assert [tuple(x) for x in one(spark, v, shapes.run_lengths, "array<int>")] == [(1, 2), (0, 1), (2, 3)]
    assert one(spark, v, lambda c: shapes.from_run_lengths(shapes.run_lengths(c)), "array<int>") == v
    assert one(spark, [], shapes.run_lengths, "array<int>") == []
    assert one(spark, [3.0, 0.0, 0.1, 2.9], lambda c: shapes.spaced_out(c, 0.2), "array<double>") == [0.0, 2.9]


def test_clipped_and_chunks(spark):
    assert one(spark, "one two three", lambda c: text.clipped(c, 9)) == "one two" and one(spark, "one", lambda c: text.clipped(c, 9)) == "one"
    got = one(spark, "A b. C d! E f? " + "long " * 9, lambda c: text.sentence_chunks(c, 9))
    assert got[:2] == ["A b. C d!", "E f?"] and re.match("long", got[2])
    assert one(spark, "[B] y || [A] x", text.in_order) == "[A] x || [B] y" and one(spark, "[A] y || [A] x", text.in_order) == "[A] y || [A] x"
