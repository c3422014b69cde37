"""Sizes of what is drawn on a picture, in pixels, from percentages; halves go to the even neighbour."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The font size at 100 percent, as a part of the picture's short side, by its shape.
LANDSCAPE_FONT, PORTRAIT_FONT = 0.058, 0.066
#: The edge of boxed letters as a part of their size; the gap above the picture's own text.
BOX_EDGE, GAP, GAP_PAST_PADDING = 0.06, 0.3, 0.08
#: Fewest letters a line may hold.
SHORTEST_LINE = 8


def _even(x: Column) -> Column:
    return F.bround(x, 0).cast("int")


def font_size(width: Column, height: Column, percent: Column) -> Column:
    ratio = F.when(height > width, PORTRAIT_FONT).otherwise(LANDSCAPE_FONT)
    return _even(F.least(width, height) * ratio * percent / 100)


def margin(length: Column, percent: Column) -> Column:
    """A margin along a side of the picture."""
    return _even(length * percent / 100)


def padding(font: Column, percent: Column) -> Column:
    """What the box adds on each side, to a tenth."""
    return F.bround(font * percent / 100, 1)


def outline(font: Column, percent: Column, boxed: Column) -> Column:
    return F.when(boxed, F.bround(font * BOX_EDGE, 1)).otherwise(F.greatest(F.lit(2), _even(font * percent / 100)).cast("double"))


def gap(padding_percent: Column) -> Column:
    """Kept above the picture's own text, as a part of the font size."""
    return F.greatest(F.lit(GAP), F.bround(padding_percent / 100 + GAP_PAST_PADDING, 4))


def letters_a_line(width: Column, height: Column, size: Column, side: Column, pad: Column, char_em: Column) -> Column:
    """How many letters fit on a line: the width less margins and paddings, by the width of a letter."""
    font = font_size(width, height, size)
    free = width - 2 * margin(width, side) - 2 * padding(font, pad)
    return (free / (font * char_em)).cast("int")


def widest_line(width: Column, height: Column, size: Column, side: Column, pad: Column, char_em: Column) -> Column:
    """The same for the check of settings: paddings are whole pixels, four at least."""
    font = font_size(width, height, size)
    free = width - 2 * margin(width, side) - 2 * F.greatest(F.lit(4), _even(font * pad / 100))
    return (free / (F.greatest(font, F.lit(1)) * char_em)).cast("int")


def fitted(line_chars: Column, source_chars: Column, width: Column, height: Column, size: Column, side: Column, pad: Column, char_em: Column) -> Column:
    """(line_chars, source_chars) as far as the picture holds them; as they are where nothing is drawn."""
    line = F.greatest(F.lit(SHORTEST_LINE), F.least(line_chars, letters_a_line(width, height, size, side, pad, char_em)))
    less = (width > 0) & (height > 0) & (line < line_chars)
    source = F.greatest(F.lit(SHORTEST_LINE), F.floor(source_chars * line / line_chars).cast("int"))
    return F.struct(F.when(less, line).otherwise(line_chars).alias("line_chars"), F.when(less, source).otherwise(source_chars).alias("source_chars"))


def over(colour: Column, opacity: Column, ground: Column) -> Column:
    """A #rrggbb colour of so many percent opacity over another."""

    def mixed(at: int) -> Column:
        a, b = (F.conv(F.substring(c, at, 2), 16, 10).cast("double") for c in (colour, ground))
        return F.lpad(F.lower(F.hex(_even(a * opacity / 100 + b * (1 - opacity / 100)))), 2, "0")

    return F.concat(F.lit("#"), mixed(2), mixed(4), mixed(6))
