r"""Text functions over columns. Patterns use \p{L}\p{N}_ for word characters: combining marks are left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scripts written without spaces between words (Thai, Lao, Burmese, Khmer, kana, Han), as ranges.
UNSPACED = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
#: Fixed value: what holds all of them, in few ranges: a text without any of it is one of words between white space.
MAY_BE_UNSPACED = r"[\x{0E00}-\x{17FF}\x{3040}-\x{FAFF}]"
#: Eastern digits and their western ones.
EASTERN, WESTERN = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"
#: Letter shapes that are folded into one, and marks that are dropped.
SHAPES_FROM, SHAPES_TO, MARKS = "أإآٱىةیکؤئ", "اااايهيكوي", "ًٌٍَُِّْٰـ"
#: Letters written more than one way, and the one that an echo is compared by.
ECHO_FROM, ECHO_TO = "يىكةأإآؤئۀ", "ییکهاااویه"
#: Sounds that are no words, each run of one letter written once.
FILLERS = "m hm mhm uh um uhm uhuh ah eh ehm erm oh huh euh ha haha hahaha whoa ugh اه آه اوه م ه м хм э эм हम्म उम्म 嗯 呃 啊 哦 唔 哈 えー あー うーん んー ん 음 흠".split()
#: Fixed value: laughter of any length.
LAUGHTER = "^([hх][aeioаеио]){2,}[hх]?$"


def norm(word: Column) -> Column:
    """Lower case, word characters and apostrophes only."""
    return F.regexp_replace(F.lower(word), r"[^\p{L}\p{N}_']", "")


def words(text: Column) -> Column:
    """The parts between white space."""
    return F.regexp_extract_all(text, F.lit(r"(\S+)"))


def tokens(text: Column) -> Column:
    """Normalised words, empty ones left out."""
    # the text at once, white space kept, so that no word is a call of its own
    return words(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_'\s]+", ""))


def split_words(text: Column) -> Column:
    """Words; those of unspaced scripts are split into characters, each with the marks that follow it."""
    one = rf"[{UNSPACED}][\p{{M}}\x{{0E31}}\x{{0E34}}-\x{{0E3A}}\x{{0E47}}-\x{{0E4E}}]*"
    # most texts are of other scripts, which a plain pattern says sooner
    return F.when(text.rlike(MAY_BE_UNSPACED), F.regexp_extract_all(text, F.lit(rf"({one}|[^\s{UNSPACED}]+)"))).otherwise(words(text))


def joined_words(parts: Column) -> Column:
    """The inverse: a space between two parts unless both are of unspaced scripts."""
    tight = lambda x: x.rlike(rf"^[{UNSPACED}]")
    ended = lambda x: x.rlike(rf"[{UNSPACED}][\p{{M}}]*$")
    one = F.aggregate(parts, F.lit(""), lambda s, x: F.when(s == "", x).otherwise(F.concat(s, F.when(ended(s) & tight(x), "").otherwise(" "), x)))
    # most texts have spaces only, and need not be built word by word
    plain = F.array_join(parts, " ")
    odd = F.exists(parts, lambda x: x.isNull() | (x == "")) | plain.rlike(f"[{UNSPACED}]")
    return F.when(odd, one).otherwise(plain)


def grams(toks: Column, size: int) -> Column:
    """The distinct runs of size tokens, each joined by spaces."""
    # shifted copies side by side, so that toks is not evaluated for each place
    got = toks
    for k in range(1, size):
        got = F.zip_with(got, F.slice(toks, k + 1, 1_000_000_000), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.filter(got, lambda g: g.isNotNull()))


def gram_hashes(toks: Column, size: int) -> Column:
    """64-bit hashes of the distinct runs of size tokens."""
    return F.transform(grams(toks, size), lambda g: F.xxhash64(g))


def letters(text: Column) -> Column:
    """How many letters and digits."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def has_letters(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def counted(text: Column) -> Column:
    """Words, those of unspaced scripts a quarter each."""
    single = F.regexp_count(text, F.lit(rf"[{UNSPACED}]"))
    rest = F.regexp_count(text, F.lit(rf"[^\s{UNSPACED}]+"))
    return F.when(text.rlike(MAY_BE_UNSPACED), rest + single * 0.25).otherwise(F.regexp_count(text, F.lit(r"\S+")).cast("double"))


def reading_seconds(text: Column, rate: float = 5.0) -> Column:
    return counted(text) / rate


def western_digits(text: Column) -> Column:
    return F.translate(text, EASTERN, WESTERN)


def normalise(text: Column, arabic: bool = True) -> Column:
    """Western digits (in Arabic), a question mark for each pair of one and !, white space squeezed and trimmed."""
    t = western_digits(text) if arabic else text
    for pair, mark in (("؟!", "؟"), ("!؟", "؟"), ("?!", "؟" if arabic else "?")):
        t = F.replace(t, F.lit(pair), F.lit(mark))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def fold(text: Column) -> Column:
    """Letter shapes folded into one, marks dropped."""
    return F.translate(F.translate(text, MARKS, ""), SHAPES_FROM, SHAPES_TO)


def echo_fold(text: Column) -> Column:
    """Letters that are written more than one way, as one."""
    return F.translate(text, ECHO_FROM, ECHO_TO)


def numbers(text: Column) -> Column:
    """Numbers of two digits at least, thousands joined, those that end in 00 left out."""
    t = F.regexp_replace(western_digits(text), r"(\d)[,٬](?=\d{3}(?!\d))", "$1")
    return F.filter(F.regexp_extract_all(t, F.lit(r"(\d\d+)")), lambda n: ~n.endswith("00"))


def inert(text: Column) -> Column:
    """Without power over mark-up: angle brackets as quotation marks."""
    return F.translate(text, "<>", "‹›")


def plain(text: Column) -> Column:
    """Tags stripped, braces as brackets."""
    return F.translate(F.regexp_replace(text, r"<[^<>]*>", ""), "{}", "()")


def only_a_sound(text: Column) -> Column:
    """Whether a text as a whole, or each of its words, is a filler, however drawn out, or laughter."""
    once = lambda t: F.regexp_replace(t, r"(.)\1+", "$1")
    sound = lambda w: w.isin(*FILLERS) | w.rlike(LAUGHTER)
    spaced = F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")
    parts = F.filter(F.split(spaced, " "), lambda w: w != "")
    return (F.size(parts) > 0) & (sound(once(F.array_join(parts, ""))) | F.forall(parts, lambda w: sound(once(w))))


def ends_sentence(text: Column) -> Column:
    return text.rlike(r"[.!?…。！？؟][\"'”’)\]]*$")


def ends_clause(text: Column) -> Column:
    return text.rlike(r"[,;:،؛、，；：][\"'”’)\]]*$")


def clipped(text: Column, most: int) -> Column:
    """At most so many characters, cut behind a word."""
    head = F.regexp_replace(F.left(text, F.lit(most)), r"\s+\S*\z", "")
    return F.when(F.length(text) <= most, text).otherwise(head)


def speaker(label: Column) -> Column:
    """The label without the tag of the piece it was heard in."""
    return F.regexp_replace(label, r"^p\d+\.", "")


def unlinked(label: Column) -> Column:
    """Whether the label has been made up for a speaker that no other label stands for."""
    return label.rlike(r"(~[pkxr]\d+)+$")


def based(label: Column) -> Column:
    return F.regexp_replace(label, r"(~[pkxr]\d+)+$", "")


def first_free(prefix: str, taken: Column) -> Column:
    """The first of prefix1, prefix2, ... that is not among the taken ones."""
    free = F.filter(F.sequence(F.lit(1), F.size(taken) + 1), lambda i: ~F.array_contains(taken, F.concat(F.lit(prefix), i)))
    return F.concat(F.lit(prefix), F.array_min(free))


def in_order(text: Column) -> Column:
    """"[A] x || [B] y": the parts by their marks, if all have one and no two the same; else as they are."""
    parts = F.transform(F.split(text, r"\|\|"), lambda p: F.trim(p))
    marked = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^\[(\w+)\]", 1).alias("mark"), p.alias("part")))
    good = F.forall(marked, lambda m: m["mark"] != "") & (F.size(F.array_distinct(F.transform(marked, lambda m: m["mark"]))) == F.size(marked))
    return F.when(good, F.array_join(F.transform(F.array_sort(marked), lambda m: m["part"]), " || ")).otherwise(text)


def parts_too_long(text: Column, budgets: Column) -> Column:
    """Whether a part of a text in parts exceeds its own budget; where counts differ, the whole text all budgets."""
    parts = F.transform(F.split(text, r"\|\|"), lambda p: F.trim(p))
    over = F.exists(F.zip_with(parts, budgets, lambda p, b: F.length(p) > b), lambda x: x)
    total = F.aggregate(budgets, F.lit(0).cast("long"), lambda s, b: s + b)
    return F.when(F.size(parts) == F.size(budgets), over).otherwise(F.length(text) > total)


def glossary_entries(text: Column, language: str | None = None) -> Column:
    """The (language, term, meaning) of each "[lang:] term = meaning" line that holds for the language; the first 50 that fit.

    A line without a language holds for all; without a language asked for, every line is taken.
    """
    lines = F.split(text, r"[\n;]")
    entry = lambda p: F.struct(F.lower(F.regexp_extract(p, r"^\s*(?:([A-Za-z]{2,3}(?:-[A-Za-z0-9]+)*)\s*:)?", 1)).alias("language"), F.trim(F.regexp_extract(p, r"^\s*(?:[A-Za-z]{2,3}(?:-[A-Za-z0-9]+)*\s*:)?([^=]*)=", 1)).alias("term"), F.trim(F.regexp_extract(p, r"=(.*)$", 1)).alias("meaning"))
    good = lambda e: (e["term"] != "") & (e["meaning"] != "") & (F.length(e["term"]) <= 200) & (F.length(e["meaning"]) <= 200)
    mine = lambda e: F.lit(True) if language is None else e["language"].isin("", language.lower())
    return F.slice(F.filter(F.transform(lines, entry), lambda e: good(e) & mine(e)), 1, 50)


def sentence_chunks(text: Column, most: int) -> Column:
    """Sentences gathered into chunks of at most so many characters; one that is longer stands alone."""
    sentences = F.regexp_extract_all(F.regexp_replace(text, r"\s+", " "), F.lit(r"([^.!?]+[.!?]*)"))
    sentences = F.filter(F.transform(sentences, lambda s: F.trim(s)), lambda s: s != "")
    return F.aggregate(
        sentences,
        F.array().cast("array<string>"),
        lambda done, s: F.when((F.size(done) > 0) & (F.length(F.element_at(done, -1)) + 1 + F.length(s) <= most), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat_ws(" ", F.element_at(done, -1), s)))).otherwise(F.concat(done, F.array(s))),
    )
