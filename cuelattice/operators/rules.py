"""Settings that hold together: rules across fields, presets laid over stored values, older names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import picture, shapes

NEAR = 1e-9


def letters_stand_out(least: float = 4.5) -> Column:
    """Text and speakers' colours stand out from what is behind them: the box over white and over black, or the outline."""
    c = F.col
    behind = F.when(c("style") == "box", F.array(picture.over(c("box_colour"), c("box_opacity"), F.lit("#ffffff")), picture.over(c("box_colour"), c("box_opacity"), F.lit("#000000")))).otherwise(F.array(c("outline_colour")))
    shown = F.concat(F.array("text_colour"), F.when(c("speaker_colours"), F.transform(F.split("speaker_palette", ","), lambda p: F.trim(p))).otherwise(F.array().cast("array<string>")))
    return F.forall(shown, lambda s: F.forall(behind, lambda b: shapes.contrast(s, b) >= least))


def line_fits(width: int = 1920, height: int = 1080) -> Column:
    return F.col("line_chars") <= picture.widest_line(F.lit(width), F.lit(height), F.col("size"), F.col("side_margin"), F.col("padding"), F.col("char_em"))


#: Each rule: the settings it ties together, the last of which gives way first, and what holds.
RULES = {
    "readable": (("min_duration", "min_readable"), lambda: F.col("min_readable") >= F.col("min_duration") - NEAR),
    "joins": (("long_pause", "join_gap"), lambda: F.col("join_gap") < F.col("long_pause") - NEAR),
    "gaps": (("min_duration", "min_gap"), lambda: F.col("min_gap") <= F.col("min_duration") / 4 + NEAR),
    "contrast": (("style", "speaker_colours", "box_colour", "outline_colour", "speaker_palette", "box_opacity", "text_colour"), letters_stand_out),
    "width": (("padding", "side_margin", "size", "line_chars"), line_fits),
    "one_line": (("dialogue_cues", "one_line"), lambda: ~(F.col("one_line") & F.col("dialogue_cues"))),
}


def broken(values: DataFrame, keys: Sequence[str], rules: Sequence[str] = tuple(RULES)) -> DataFrame:
    """keys, rule: the rules that a row of typed settings breaks; a rule over an unset value holds."""
    names = F.array_compact(F.array(*[F.when(~F.coalesce(RULES[r][1](), F.lit(True)), F.lit(r)) for r in rules]))
    return values.select(*keys, F.explode(names).alias("rule"))


def fallen_back(values: DataFrame, defaults: dict[str, object], rules: Sequence[str] = tuple(RULES)) -> DataFrame:
    """values with every setting that breaks a rule back at its default, the last of a rule's settings that differs first.

    A setting falls back once at most, so as many steps as there are settings end it; each is a projection.
    """
    d = values
    for rule in rules:
        for name in reversed([n for n in RULES[rule][0] if n in defaults]):
            back = ~F.coalesce(RULES[rule][1](), F.lit(True))
            d = d.withColumn(name, F.when(back, F.lit(defaults[name]).cast(dict(values.dtypes)[name])).otherwise(F.col(name)))
    return d


def nearest_holding(values: DataFrame, name: str, low: float, high: float, step: float, rules: Sequence[str]) -> DataFrame:
    """values with nearest: of the setting's steps that keep the rules, the one closest to its value, of equals the smaller; null if there is none."""
    holds = F.lit(True)
    for r in rules:
        holds = holds & F.coalesce(RULES[r][1](), F.lit(True))
    kind = dict(values.dtypes)[name]
    # each step is tried in the row itself: no row becomes many
    d, tried = values.withColumn("__asked", F.col(name)), []
    for i in range(round((high - low) / step) + 1):
        d = d.withColumn(name, F.round(F.lit(low + i * step), 4).cast(kind)).withColumn(f"__holds{i}", holds)
        tried.append(F.when(F.col(f"__holds{i}"), F.struct(F.abs(F.round(F.lit(low + i * step), 4) - F.col("__asked")).alias("d"), F.round(F.lit(low + i * step), 4).alias("v"))))
    own = [F.col("__asked").alias(c) if c == name else F.col(c) for c in values.columns]
    return d.select(*own, F.array_min(F.array(*tried))["v"].alias("nearest"))


def laid_over(stored: Column, preset: Column, defaults: Column, outside: Sequence[str] = ()) -> Column:
    """A preset over stored values (maps of texts): what it names replaces them, and nothing that equals its default is kept.

    Names outside presets stay as they are stored.
    """
    keep = lambda k: k.isin(*outside) if outside else F.lit(False)
    named = F.map_filter(preset, lambda k, v: ~keep(k))
    rest = F.map_filter(stored, lambda k, v: ~F.map_contains_key(named, k))
    return F.map_concat(rest, F.map_filter(named, lambda k, v: ~v.eqNullSafe(F.element_at(defaults, k))))


def original(stored: Column, outside: Sequence[str] = ()) -> Column:
    """Stored values with everything that presets touch back at its default."""
    return F.map_filter(stored, lambda k, v: k.isin(*outside) if outside else F.lit(False))


def active(stored: Column, presets: dict[str, Column], defaults: Column, outside: Sequence[str] = ()) -> Column:
    """The first preset that the stored values are exactly, else empty."""
    sorted_ = lambda m: F.sort_array(F.map_entries(m))
    base = original(stored, outside)
    found = [F.when(sorted_(laid_over(base, p, defaults, outside)) == sorted_(stored), F.lit(n)) for n, p in presets.items()]
    return F.coalesce(*found, F.lit(""))


def migrated(old: Column, names: dict[str, str], allowed: Column, defaults: Column) -> Column:
    """Values under their older names, as stored ones: empty, refused (not among those allowed for the name) and default values are left out."""
    pairs = F.array(*[F.struct(F.lit(new).alias("k"), F.element_at(old, F.lit(was)).alias("v")) for was, new in names.items()])
    good = lambda p: (F.coalesce(p["v"], F.lit("")) != "") & ~p["v"].eqNullSafe(F.element_at(defaults, p["k"])) & F.coalesce(F.array_contains(F.element_at(allowed, p["k"]), p["v"]), F.lit(True))
    return F.map_from_entries(F.filter(pairs, good))


def kept_from(raw: Column) -> Column:
    """The (values, presets) of a stored JSON text; what can't be read leaves both empty."""
    parsed = F.from_json(raw, "values map<string,string>, presets map<string,map<string,string>>")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.struct(F.coalesce(parsed["values"], none).alias("values"), F.coalesce(parsed["presets"], F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<map<string,string>>"))).alias("presets"))
