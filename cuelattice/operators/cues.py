"""Cues on screen: checks, budgets, blocks and lines. Times are whole milliseconds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import picture, shapes, text


def _order(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("number")


def qa_issues(cues: DataFrame, keys: Sequence[str], cps: float = 17.0, line: int = 42, lines: int = 2, least_ms: int = 900, gap_ms: int = 83) -> DataFrame:
    """keys, number, kind: a row for each thing that is wrong with a cue."""
    seconds = (F.col("end_ms") - F.col("start_ms")) / 1000
    shown = F.split("text", "\n")
    nxt = F.lead("start_ms").over(_order(keys))
    checks = [
        ("untranslated", F.trim("text") == ""),
        ("line_length", F.exists(shown, lambda x: F.length(x) > line)),
        ("too_many_lines", F.size(shown) > lines),
        ("reading_speed", F.length("text") > seconds * cps * 1.25),
        ("too_short", F.col("end_ms") - F.col("start_ms") < least_ms),
        ("overlap", F.coalesce(F.col("end_ms") > nxt - gap_ms, F.lit(False))),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks]))
    return cues.withColumn("__kinds", found).select(*keys, "number", F.explode("__kinds").alias("kind"))


def readable_ends(cues: DataFrame, keys: Sequence[str], cps: float, most_ms: int, gap_ms: int, more_ms: int = 2000, cuts: DataFrame | None = None) -> DataFrame:
    """cues with new_end_ms: long enough to read, but not beyond the next cue, the next cut of the picture (at_ms), the longest time or more_ms more."""
    wanted = F.col("start_ms") + F.ceil(F.length("text") * 1000 / cps).cast("long") + 1
    nxt = F.lead("start_ms").over(_order(keys)) - gap_ms
    end = F.least(wanted, F.col("end_ms") + more_ms, F.col("start_ms") + most_ms, nxt)
    if cuts is None:
        return cues.withColumn("new_end_ms", F.greatest(F.col("end_ms"), end))
    # cues by their end and cuts in one order: the first cut behind an end bounds it
    own = cues.select(*keys, F.col("number").alias("__n"), F.col("end_ms").cast("long").alias("__t"), F.lit(1).alias("__cue"))
    both = own.unionByName(cuts.select(*keys, F.lit(None).cast(dict(cues.dtypes)["number"]).alias("__n"), F.col("at_ms").cast("long").alias("__t"), F.lit(0).alias("__cue")))
    later = Window.partitionBy(*keys).orderBy("__t", "__cue").rowsBetween(1, Window.unboundedFollowing)
    both = both.withColumn("__cut", F.first(F.when(F.col("__cue") == 0, F.col("__t")), ignorenulls=True).over(later)).where("__cue = 1")
    d = cues.join(both.select(*keys, F.col("__n").alias("number"), "__cut"), [*keys, "number"], "left")
    return d.withColumn("new_end_ms", F.greatest(F.col("end_ms"), F.least(end, "__cut"))).select(*cues.columns, "new_end_ms")


def stages(cues: DataFrame, apart: float = 0.4) -> DataFrame:
    """cues with stage, shown, from_ms: a cue of two parts ("a || b") is shown in two stages if its halves are long enough."""
    parts = F.transform(F.split("text", r"\|\|"), lambda p: F.trim(p))
    half = ((F.col("start_ms") + F.col("end_ms")) / 2).cast("long")
    at = F.when(F.size(parts) == 2, shapes.reveal_at(F.col("start_ms") / 1000, half / 1000, F.col("end_ms") / 1000, apart))
    whole = F.array(F.struct(F.array_join(F.transform(parts, lambda p: F.concat(F.lit("- "), p)), "\n").alias("shown"), F.col("start_ms").alias("from_ms"), F.col("end_ms").alias("until_ms")))
    single = F.array(F.struct(F.element_at(parts, 1).alias("shown"), F.col("start_ms").alias("from_ms"), F.col("end_ms").alias("until_ms")))
    staged = F.array(
        F.struct(F.concat(F.lit("- "), F.element_at(parts, 1)).alias("shown"), F.col("start_ms").alias("from_ms"), half.alias("until_ms")),
        F.struct(F.concat(F.lit("- "), F.element_at(parts, 1), F.lit("\n- "), F.element_at(parts, -1)).alias("shown"), half.alias("from_ms"), F.col("end_ms").alias("until_ms")),
    )
    return cues.withColumn("__s", F.when(at.isNotNull(), staged).when(F.size(parts) > 1, whole).otherwise(single)).select(*cues.columns, F.posexplode("__s").alias("stage", "__x")).select(*cues.columns, "stage", "__x.*")


def srt_blocks(cues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, block, line: the numbered blocks of an SRT file, empty cues left out."""
    s = stages(cues.where(F.trim("text") != ""))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("number", "stage"))
    line = F.concat_ws("\n", n.cast("string"), F.concat(shapes.srt_time(F.col("from_ms")), F.lit(" --> "), shapes.srt_time(F.col("until_ms"))), text.plain(F.col("shown")), F.lit(""))
    return s.select(*keys, n.cast("long").alias("block"), line.alias("line"))


def srt_files(cues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, srt: one text for each clip."""
    got = srt_blocks(cues, keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("block", "line"))).alias("b"))
    return got.select(*keys, F.array_join(F.transform("b", lambda x: x["line"]), "\n").alias("srt"))


#: The colour of who talks most, then those that the others take in turn.
PALETTE = ["#f7f5f0", "#ffe066", "#8fe3f5", "#a8e6a1"]


def ass_events(cues: DataFrame, keys: Sequence[str], ranks: DataFrame, fade_ms: int = 200) -> DataFrame:
    """keys, number, event: Dialogue lines; the talk rank of a speaker gives the colour, a fade takes at most a quarter of the time."""
    n = len(PALETTE) - 1
    colours = F.array(*map(F.lit, PALETTE))
    rank = F.coalesce("rank", F.lit(0))
    colour = F.element_at(colours, F.when(rank == 0, 1).otherwise(F.pmod(rank - 1, F.lit(n)) + 2).cast("int"))
    fade = F.least(F.lit(fade_ms), F.floor((F.col("end_ms") - F.col("start_ms")) / 4).cast("int"))
    body = F.replace(text.plain(F.col("text")), F.lit("\n"), F.lit(r"\N"))
    style = F.concat(F.lit(r"{\fad("), fade, F.lit(","), fade, F.lit(r")\c"), shapes.ass_colour(colour, F.lit(1.0)), F.lit("&}"))
    event = F.concat(F.lit("Dialogue: 0,"), shapes.ass_time(F.col("start_ms")), F.lit(","), shapes.ass_time(F.col("end_ms")), F.lit(",Default,,0,0,0,,"), style, body)
    return cues.join(ranks, [*keys, "speaker"], "left").select(*keys, "number", event.alias("event"))


#: What an ASS file says before its events.
ASS_INFO = ["[Script Info]", "ScriptType: v4.00+", "WrapStyle: 0", "ScaledBorderAndShadow: yes"]
ASS_STYLES = ["[V4+ Styles]", "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"]
ASS_EVENTS = ["[Events]", "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"]


def ass_files(cues: DataFrame, keys: Sequence[str], ranks: DataFrame, width: int = 1920, height: int = 1080, font: str = "Sans", size: float = 100.0, side: float = 5.0, bottom: float = 7.0, box: str = "#151413", opacity: float = 0.69) -> DataFrame:
    """keys, ass: a whole file for each clip: the picture's size, one style with sizes from percentages, and its events in order."""
    w, h = F.lit(width), F.lit(height)
    letter = picture.font_size(w, h, F.lit(size))
    margin, below = picture.margin(w, F.lit(side)), picture.margin(h, F.lit(bottom))
    behind = shapes.ass_colour(F.lit(box), F.lit(opacity))
    style = F.concat_ws(",", F.lit(f"Style: Default,{font}"), letter, shapes.ass_colour(F.lit(PALETTE[0]), F.lit(1.0)), F.lit("&H000000FF"), behind, behind, F.lit("0,0,0,0,100,100,0,0,3"), picture.outline(letter, F.lit(0.0), F.lit(True)), F.lit("0,2"), margin, margin, below, F.lit("1"))
    head = F.concat_ws("\n", *map(F.lit, ASS_INFO), F.lit(f"PlayResX: {width}"), F.lit(f"PlayResY: {height}"), F.lit(""), *map(F.lit, ASS_STYLES), style, F.lit(""), *map(F.lit, ASS_EVENTS))
    got = ass_events(cues, keys, ranks).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("number", "event"))).alias("e"))
    return got.select(*keys, F.concat(head, F.lit("\n"), F.array_join(F.transform("e", lambda x: x["event"]), "\n"), F.lit("\n")).alias("ass"))


def dub_lines(cues: DataFrame, keys: Sequence[str], total_ms: int) -> DataFrame:
    """keys, number, part, text, until_ms: parts to be spoken, until the next start (half a second at least) or 30 s on."""
    nxt = F.lead("start_ms").over(_order(keys))
    until = F.when(nxt.isNull(), F.least(F.lit(total_ms).cast("long"), F.col("start_ms") + 30_000)).otherwise(F.greatest(nxt, F.col("start_ms") + 500))
    d = cues.withColumn("until_ms", until)
    parts = F.transform(F.split("text", r"\|\|"), lambda p: F.trim(p))
    return d.select(*keys, "number", F.posexplode(parts).alias("part", "text"), "until_ms")


def batches(cues: DataFrame, keys: Sequence[str], span_ms: int, most: int) -> DataFrame:
    """cues with batch: a new one where the first cue of the current one started span_ms ago or it has most cues.

    Greedy in order, so a fold over each clip's starts.
    """
    w = cues.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("number", "start_ms"))).alias("c"))
    zero = F.struct(F.array().cast("array<struct<number:bigint,batch:int>>").alias("out"), F.lit(None).cast("bigint").alias("since"), F.lit(0).alias("n"), F.lit(0).alias("batch"))

    def step(s, c):
        fresh = s["since"].isNull() | (c["start_ms"] - s["since"] >= span_ms) | (s["n"] >= most)
        batch = s["batch"] + F.when(fresh, 1).otherwise(0)
        return F.struct(
            F.concat(s["out"], F.array(F.struct(c["number"].cast("bigint").alias("number"), batch.alias("batch")))).alias("out"),
            F.when(fresh, c["start_ms"]).otherwise(s["since"]).alias("since"),
            F.when(fresh, F.lit(1)).otherwise(s["n"] + 1).alias("n"),
            batch.alias("batch"),
        )

    got = w.select(*keys, F.explode(F.aggregate("c", zero, step, lambda s: s["out"])).alias("o")).select(*keys, "o.number", "o.batch")
    return cues.join(got, [*keys, "number"])


def balanced(sentence: Column, most: int = 42) -> Column:
    """A text in at most two lines, cut where they are most alike; a clause's end counts for 12 characters."""
    w = text.words(sentence)
    n = F.size(w)
    first = lambda i: F.array_join(F.slice(w, F.lit(1), i), " ")
    second = lambda i: F.array_join(F.slice(w, i + 1, n), " ")
    over = lambda x: F.when(F.length(x) > most, 1000).otherwise(0)
    cost = lambda i: F.abs(F.length(first(i)) - F.length(second(i))) - F.when(text.ends_clause(F.element_at(w, i)) | text.ends_sentence(F.element_at(w, i)), 12).otherwise(0) + over(first(i)) + over(second(i))
    best = F.array_min(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(cost(i).alias("cost"), i.alias("i"))))["i"]
    whole = F.array_join(w, " ")
    return F.when((F.length(whole) <= most) | (n < 2), F.array(whole)).otherwise(F.array(first(best), second(best)))


def best_split(words: Column) -> Column:
    """The place after which to split timed words (text, s, e): 2 for a sentence's end, 1 for a clause's, twice the pause in
    seconds, less the pause's distance from the middle of their time as a share of it; first of equals."""
    n = F.size(words)
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    span = F.greatest(last["e"] - first["s"], F.lit(1))

    def score(i):
        before, after = F.element_at(words, i), F.element_at(words, i + 1)
        mark = F.when(text.ends_sentence(before["text"]), 2.0).when(text.ends_clause(before["text"]), 1.0).otherwise(0.0)
        return mark + 2 * (after["s"] - before["e"]) / 1e6 - F.abs(before["e"] + after["s"] - first["s"] - last["e"]) / 2 / span

    return F.when(n > 1, F.array_max(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.round(score(i), 9).alias("score"), (-i).alias("i"))))["i"] * -1)


def thinned(lines: DataFrame, keys: Sequence[str], group: int, most: int) -> DataFrame:
    """Of more than most groups of lines every step-th, so that most remain; fewer stay as they are."""
    w = Window.partitionBy(*keys).orderBy("number")
    place = F.floor((F.row_number().over(w) - 1) / group)
    groups = F.ceil(F.count("*").over(Window.partitionBy(*keys)) / group)
    return lines.withColumns({"__g": place, "__n": groups}).where(F.col("__g") % F.greatest(F.lit(1), F.ceil(F.col("__n") / most)) == 0).drop("__g", "__n")


def spread_order(df: DataFrame, keys: Sequence[str], at: str, step: int = 4) -> DataFrame:
    """df with turn: every step-th row first, then those between."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(at)) - 1
    d = df.withColumn("__i", place)
    return d.withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("__i") % step, "__i")).cast("long")).drop("__i")


def piece_plan(clips: DataFrame, pauses: DataFrame, keys: Sequence[str], target: int, tail: float = 0.3, share: float = 0.2, most: int = 30) -> DataFrame:
    """keys, piece, s, e: cuts about target apart, each at the longest pause near its aim; ties go to the nearer.

    clips has keys and length, pauses keys, s and e. Each next aim depends on the last cut: a fold over the
    clip's pauses, which are one row's worth.
    """
    p = pauses.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("p"))
    reach = F.least(F.lit(most), F.lit(int(target * share)))
    d = clips.join(p, list(keys), "left").withColumn("p", F.coalesce("p", F.array().cast("array<struct<s:bigint,e:bigint>>")))
    steps = F.sequence(F.lit(1), F.ceil(F.col("length") / (target - reach)).cast("int") + 1)

    def step(cuts, _):
        last = F.coalesce(F.element_at(F.col("cuts") if cuts is None else cuts, -1), F.lit(0).cast("bigint"))
        aim = last + target
        near = F.filter("p", lambda x: (F.abs((x["s"] + x["e"]) / 2 - aim) <= reach) & (x["e"] > x["s"]))
        best = F.array_max(F.transform(near, lambda x: F.struct((x["e"] - x["s"]).alias("long"), (-F.abs(x["s"] + x["e"] - 2 * aim)).alias("near"), F.floor((x["s"] + x["e"]) / 2).cast("bigint").alias("at"))))
        at = F.coalesce(best["at"], aim).cast("bigint")
        return F.when(F.col("length") - aim < target * tail, cuts).otherwise(F.concat(cuts, F.array(at)))

    start = F.array(F.lit(0).cast("bigint"))
    cuts = F.aggregate(steps, start, step)
    ends = F.concat(F.slice(cuts, 2, 1_000_000), F.array(F.col("length").cast("bigint")))
    return d.select(*keys, F.posexplode(F.arrays_zip(cuts.alias("s"), ends.alias("e"))).alias("piece", "x")).select(*keys, "piece", "x.s", "x.e")
