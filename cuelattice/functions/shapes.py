"""Times, colours, budgets and other arithmetic over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def milliseconds(seconds: Column) -> Column:
    """Half-even, not below 0."""
    return F.greatest(F.bround(seconds * 1000, 0).cast("long"), F.lit(0).cast("long"))


def srt_time(ms: Column) -> Column:
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def ass_time(ms: Column) -> Column:
    return F.format_string("%d:%02d:%02d.%02d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, F.floor(ms % 1000 / 10))


def char_budget(seconds: Column, cps: float, most: int = 84, least: int = 12) -> Column:
    """Characters that can be read in the time."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.floor(seconds * cps).cast("int")))


def part_budgets(seconds: Column, parts: Column, cps: float, line: int = 42, least: int = 12) -> Column:
    """The budget of each part of a text that is shared by several."""
    share = F.floor(char_budget(seconds, cps) / parts).cast("int")
    return F.array_repeat(F.least(F.greatest(F.lit(least), share), F.lit(line - 2)), parts)


def read_back(seconds: Column) -> Column:
    """A time whose minutes and seconds were written side by side (109.12 for 1:09.12), as seconds; else null."""
    return F.when(seconds % 100 < 60, 60 * F.floor(seconds / 100) + seconds % 100)


def reveal_at(start: Column, second: Column, end: Column, apart: float = 0.4) -> Column:
    """When the second part of a two-part cue appears, if far enough from both ends."""
    return F.when(second.between(start + apart, end - apart), second)


def _channel(colour: Column, at: int) -> Column:
    c = F.conv(F.substring(colour, at, 2), 16, 10).cast("double") / 255
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def luminance(colour: Column) -> Column:
    """Of a #rrggbb colour, by WCAG 2."""
    return 0.2126 * _channel(colour, 2) + 0.7152 * _channel(colour, 4) + 0.0722 * _channel(colour, 6)


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def ass_colour(colour: Column, opacity: Column) -> Column:
    """#rrggbb as &HAABBGGRR, where AA is how transparent it is."""
    alpha = F.lpad(F.hex(F.bround((1 - opacity) * 255, 0).cast("int")), 2, "0")
    return F.upper(F.concat(F.lit("&H"), alpha, F.substring(colour, 6, 2), F.substring(colour, 4, 2), F.substring(colour, 2, 2)))


def enlarged(width: Column, height: Column, frame_w: int, frame_h: int, least: float = 1.1) -> Column:
    """Even sides that fill the frame, if that is a gain; else null."""
    scale = F.least(frame_w / width, frame_h / height)
    even = lambda x: (2 * F.bround(x / 2, 0)).cast("int")
    return F.when(scale >= least, F.struct(even(width * scale).alias("width"), even(height * scale).alias("height")))


def plausible_word(seconds: Column, letters: Column) -> Column:
    return (seconds > 0) & (seconds <= 2 * (0.3 + 0.1 * letters))


def plausible_line(seconds: Column, count: Column) -> Column:
    return (seconds <= 60) & ((count < 10) | (count <= 8 * F.greatest(seconds, F.lit(0.1))))


def run_lengths(values: Column) -> Column:
    """(value, n) of each run of equal values of an array."""
    start = F.array().cast("array<struct<value:int,n:int>>")
    last = lambda s: F.element_at(s, -1)
    one = lambda v, n: F.array(F.struct(v.cast("int").alias("value"), n.cast("int").alias("n")))
    return F.aggregate(values, start, lambda s, v: F.when((F.size(s) > 0) & (last(s)["value"] == v), F.concat(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), one(v, last(s)["n"] + 1))).otherwise(F.concat(s, one(v, F.lit(1)))))


def from_run_lengths(runs: Column) -> Column:
    return F.flatten(F.transform(runs, lambda r: F.array_repeat(r["value"], r["n"])))


def spaced_out(times: Column, apart: float) -> Column:
    """Of an array of times in order those that stand so far apart from the last one kept."""
    start = F.array().cast("array<double>")
    return F.aggregate(F.array_sort(times), start, lambda s, t: F.when((F.size(s) == 0) | (t - F.element_at(s, -1) >= apart), F.concat(s, F.array(t))).otherwise(s))
