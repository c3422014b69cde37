"""Numbers as they are spoken: groups of thousands joined, digits written as words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English words of numbers.
SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = ["", " thousand", " million", " billion", " trillion"]


def joined(words: Column) -> Column:
    """Words of a line, a word of just three digits moved onto the number before it; what is moved leaves an empty word."""
    group = r"^\d{3}\W*$"

    def step(out, w):
        own = F.coalesce(F.array_max(F.transform(out, lambda x, i: F.when(x != "", i))), F.lit(-1))
        goes = w.rlike(group) & (own >= 0) & F.get(out, own).rlike(r"\d$")
        moved = F.transform(out, lambda x, i: F.when(i == own, F.concat(x, w)).otherwise(x))
        return F.concat(F.when(goes, moved).otherwise(out), F.array(F.when(goes, F.lit("")).otherwise(w)))

    return F.aggregate(words, F.array().cast("array<string>"), step)


def ungrouped(text: Column) -> Column:
    """Numbers without the marks between their thousands."""
    return F.regexp_replace(text, r"(?<=\d)[ ,.  ](?=\d{3}(?!\d))", "")


def _below_thousand(n: Column) -> Column:
    words, tens = F.array(*map(F.lit, SMALL)), F.array(*map(F.lit, TENS))
    two = n % 100
    last = F.when(two < 20, F.get(words, two.cast("int"))).otherwise(F.concat(F.get(tens, (F.floor(two / 10) - 2).cast("int")), F.when(two % 10 > 0, F.concat(F.lit("-"), F.get(words, (two % 10).cast("int")))).otherwise("")))
    hundred = F.concat(F.get(words, F.floor(n / 100).cast("int")), F.lit(" hundred"))
    return F.when(n < 100, last).when(two == 0, hundred).otherwise(F.concat(hundred, F.lit(" and "), last))


def english(n: Column) -> Column:
    """A whole number below 10**15 in English words; null beyond."""
    parts = []
    for k, scale in reversed(list(enumerate(SCALES))):
        part = F.floor(n / 10 ** (3 * k)) % 1000
        said = F.concat(_below_thousand(part), F.lit(scale))
        if k == 0:
            said = F.when((part < 100) & (n >= 1000), F.concat(F.lit("and "), _below_thousand(part))).otherwise(said)
        parts.append(F.when(part > 0, said))
    whole = F.array_compact(F.array(*parts))
    text = F.regexp_replace(F.array_join(whole, ", "), ", and ", " and ")
    return F.when(n == 0, SMALL[0]).when((n > 0) & (n < 10**15), text)


def said(text: Column, spell: Callable[[Column], Column] = english) -> Column:
    """A text with each number spelled; one that can't be spelled stays.

    Digits and what stands between them alternate, so both are split and put together again.
    """
    plain = ungrouped(text)
    numbers = F.regexp_extract_all(plain, F.lit(r"(\d+)"))
    rest = F.split(plain, r"\d+", -1)
    words = F.transform(numbers, lambda d: F.coalesce(spell(d.try_cast("bigint")), d))
    return F.array_join(F.flatten(F.transform(rest, lambda r, i: F.array(r, F.coalesce(F.get(words, i), F.lit(""))))), "")
