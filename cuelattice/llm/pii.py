r"""Personal data: fixed patterns, and terms that reveal the entities these patterns find.

The values that the patterns match (addresses, numbers) are the protected entities. Over the whole corpus
it is counted in how many documents a term stands together with an entity, and in how many each of the two
stands at all. Their pointwise mutual information, over the information content of the entity, says how much
of the entity the term gives away: 1 if the term stands nowhere but with it. Terms beyond one threshold are
generalised to their kind, terms beyond a second one are removed, wherever they stand.

A term counts only if more documents hold both than chance would bring together. Near copies say the same
thing, so what is counted there is the effective number of documents: copies of one text are one, and
texts that share the least of their scattered pairs of terms are taken together. Two independent documents are enough.

The corpus is read twice. The first time tells how many documents hold each term, summed per task before any
shuffle, and, of documents with an entity, their terms; all else is joins and sums over those. The second time
rewrites the texts. Up to a bound of revealing terms these go to every task; beyond it the places where a
filter of fixed size lets a term pass are joined with the terms, so that no task holds them all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, Scratch, as_bytes, fresh, mix64, shingle_hashes, small, term_blocks

#: In the order in which spans of one start stand.
KINDS = ("email", "ip", "card", "phone", "term")
#: Independent documents in which a term and an entity must meet at least, and the probability, at most, that
#: so many would meet by chance.
SUPPORT, CHANCE = 2.0, 1e-4
#: Shares of the entity's information from which a term is generalised, and removed.
GENERALISE, REMOVE = 0.9, 0.99
#: Revealing terms that go to every task: 16 MB of hashes and shares. More are joined.
HELD = 1_000_000
#: A text whose entities and terms make more pairs is dealt out in blocks of so many terms.
PAIRS, TERMS = 1 << 20, 512
#: Words of 64 bits, as a power of two, of the filter that thins out what is joined: 32 MB at most.
FILTER = 22
#: Different terms that a task counts before it passes them on.
COUNTED = 1_000_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match of these two starts where a run of digits starts, so looking back once is enough
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    double = digits[-2::-2]
    return (sum(map(int, digits[-1::-2])) + sum(int(d) * 2 - 9 * (d > "4") for d in double)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with a domain behind it takes all of the run of local characters before it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, in order; kind is a place in KINDS."""
    found = [(a, 0, b) for a, b in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _DIGITS.sub("", m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.sub("", m[0])) <= 15]
    return sorted(found)


def entity(kind: int, value: str) -> int:
    """A number that stands for the protected value, however it is written."""
    value = value.lower() if kind == 0 else value if kind == 1 else _DIGITS.sub("", value)
    return xxhash.xxh3_64_intdigest(f"{kind}:{value}".encode("utf-8", "surrogatepass")) - 2**63


def byte_places(raw: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The byte at which each code point, in ascending order, starts; the end for one behind the last."""
    out, base = np.full(len(points), len(raw), np.int64), 0
    for at in range(0, len(raw), BLOCK):
        lead = np.flatnonzero((raw[at : at + BLOCK] & 0xC0) != 0x80)
        low, high = np.searchsorted(points, (base, base + len(lead)))
        out[low:high] = at + lead[points[low:high] - base]
        base += len(lead)
    return out


def code_points(raw: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many code points start before each byte, in ascending order."""
    out, base = np.empty(len(places), np.int64), 0
    for at in range(0, len(raw), BLOCK):
        upto = np.concatenate(([0], np.cumsum((raw[at : at + BLOCK] & 0xC0) != 0x80)))
        low, high = np.searchsorted(places, (at, at + len(upto) - 1))
        out[low:high] = base + upto[places[low:high] - at]
        base += int(upto[-1])
    out[np.searchsorted(places, len(raw)) :] = base
    return out


def _islands(raw: np.ndarray, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of what the spans cover together."""
    start = np.array([s for s, _, _ in spans])
    reach = np.maximum.accumulate([e for _, _, e in spans])
    fresh_ = np.concatenate(([True], start[1:] >= reach[:-1]))
    first, last = start[fresh_], reach[np.append(np.flatnonzero(fresh_)[1:] - 1, len(reach) - 1)]
    return byte_places(raw, first), byte_places(raw, last)


def terms_of(raw: np.ndarray, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """The different terms of a text, those of them that stand outside the spans, and the mark of its pairs of terms."""
    low, high = _islands(raw, spans) if spans else (None, None)
    every, clear, mark = [], [], np.uint64(2**64 - 1)
    for h, start, end in term_blocks(raw):
        if spans:
            at = np.searchsorted(high, start, "right")
            inside = (at < len(low)) & (low[np.minimum(at, len(low) - 1)] < end)
            clear.append(np.unique(h[~inside].view(np.int64)))
            if len(h):
                mark = min(mark, mix64(shingle_hashes(h, 2)).min())
        every.append(np.unique(h.view(np.int64)))
    none = np.empty(0, np.int64)
    every = np.unique(np.concatenate([none, *every])) if len(every) != 1 else every[0]
    return every, np.unique(np.concatenate([none, *clear])), int(mix64(np.array([mark]))[0]) & 255


_FACTS = "k1 long, k2 long, mark int, entities array<long>, terms array<long>, term long, docs long"
_LONGS = pa.list_(pa.int64())


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (term, docs) for the terms of a task's documents, and one of the others for each document with entities."""
    names = [c.split()[0] for c in _FACTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), _LONGS, _LONGS, pa.int64(), pa.int64()]
    seen, counts, waiting = np.empty(0, np.int64), np.empty(0, np.int64), []

    def summed():
        nonlocal seen, counts, waiting
        keys = np.concatenate([seen, *waiting])
        n = np.concatenate([counts, np.ones(len(keys) - len(seen), np.int64)])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
        seen, counts, waiting = keys[first], np.add.reduceat(n, first) if len(first) else n, []

    def told():
        for at in range(0, len(seen), 100_000):
            part = slice(at, at + 100_000)
            columns = [pa.nulls(len(seen[part]), t) for t in kinds[:5]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(seen[part]), pa.array(counts[part])], names=names)

    held = 0
    for batch in batches:
        rows = []
        for text, k1, k2 in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = as_bytes(text)
            if not len(raw):
                continue
            spans = base_spans(text := text.as_py())
            every, clear, mark = terms_of(raw, spans)
            waiting.append(every)
            held += len(every)
            if spans:
                rows.append((k1, k2, mark, sorted({entity(kind, text[s:e]) for s, kind, e in spans}), clear))
            if held > 2 * COUNTED:
                summed()
                held = 0
                if len(seen) > COUNTED:
                    yield from told()
                    seen, counts = seen[:0], counts[:0]
        if rows:
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64())], names=names)
    summed()
    yield from told()


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """The texts with two numbers that stand for them."""
    return docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("k1"), F.xxhash64(F.lit(1), text_col).alias("k2"))


def revealing_terms(docs: DataFrame, scratch: Scratch, support: float = SUPPORT, least: float = GENERALISE, text_col: str = "text") -> DataFrame:
    """(term, share): hashes of terms that reveal an entity, with the largest share of an entity's information they give.

    All counts are of documents over the whole corpus, rows of copies included; support is the effective
    number of documents in which both stand.
    """
    facts = scratch.write(_keyed(docs, text_col).mapInArrow(_facts, _FACTS), "facts")
    # copies of one text are one holder
    own = facts.where("k1 is not null").groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.first("mark").alias("mark"), F.first("entities").alias("entities"), F.first("terms").alias("terms"))
    holders = scratch.write(own, "holders")
    met = holders.select("k1", "k2", "copies", F.explode("entities").alias("entity"))
    first, second = F.xxhash64("k1", "k2"), F.xxhash64("k2", "k1")
    entities = met.groupBy("entity").agg(F.sum("copies").alias("with_entity"), F.count("*").alias("texts"), F.bit_xor(first).alias("b1"), F.bit_xor(second).alias("b2"))
    # an entity of a single text can't be told from any other by what stands with it; those that stand in the same texts count alike and go on as one
    entities = scratch.write(entities.where("texts > 1").select(F.col("entity").alias("name"), F.xxhash64("b1", "b2", "texts").alias("entity"), "with_entity"), "entities")
    named = met.withColumnRenamed("entity", "name").join(small(entities.select("name", "entity"), 24), "name")
    again = scratch.write(named.groupBy("k1", "k2").agg(F.collect_set("entity").alias("known")), "again")
    entities = entities.select("entity", "with_entity").distinct()
    held = holders.select("k1", "k2", "copies", "mark", "terms").join(again, ["k1", "k2"])
    # a text of many entities and terms is dealt out in blocks of terms before they are paired
    large = F.size("known").cast("long") * F.size("terms") > PAIRS
    starts = F.sequence(F.lit(1), F.greatest(F.size("terms"), F.lit(1)), F.lit(TERMS))
    blocks = held.where(large).withColumn("at", F.explode(starts)).repartition("k1", "k2", "at").withColumn("terms", F.slice("terms", F.col("at"), F.lit(TERMS))).drop("at")
    pairs = held.where(~large).unionByName(blocks)
    pairs = pairs.select("copies", "mark", F.explode("known").alias("entity"), "terms").select("copies", "mark", "entity", F.explode("terms").alias("term"))
    by_mark = pairs.groupBy("entity", "term", "mark").agg(F.sum("copies").alias("both"), F.count("*").cast("double").alias("n"))
    both = by_mark.groupBy("entity", "term").agg(F.sum("both").alias("both"), (F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n"))).alias("support"))
    both = scratch.write(both.where(F.col("support") >= support - 1e-9), "both")
    terms = scratch.write(both.select("term").distinct(), "terms")
    counted = facts.where("term is not null").select("term", "docs").join(small(terms, 16), "term").groupBy("term").agg(F.sum("docs").alias("with_term"))
    counted = scratch.write(counted, "counted")
    total = F.lit(float(docs.count()))
    d = both.join(small(entities, 32), "entity").join(small(counted, 32), "term")
    information = -F.log(F.col("with_entity") / total)
    mutual = F.log(F.col("both") * total / (F.col("with_entity") * F.col("with_term")))
    share = F.when(information > 0, mutual / information).otherwise(F.lit(0.0))
    # Chernoff's bound of the chance that so many of the entity's documents hold a term of that frequency
    rate, by_chance = F.col("both") / F.col("with_entity"), F.col("with_term") / total
    apart = rate * F.log(rate / by_chance) + F.when(rate < 1, (1 - rate) * F.log((1 - rate) / (1 - by_chance))).otherwise(F.lit(0.0))
    good = (by_chance < rate) & (-F.col("support") / rate * apart <= float(np.log(CHANCE)))
    return scratch.write(d.withColumn("share", share).where(good & (F.col("share") >= least)).groupBy("term").agg(F.max("share").alias("share")), "revealing")


def _tag(word: str) -> str:
    return "[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[WORD]"


def rewrite(text: str, spans: list[tuple[int, int, int]], removed: set[int]) -> str:
    """text with entities generalised to their kind, terms to theirs or removed; removed holds starts."""
    out, free = [], 0
    for start, kind, end in spans:
        if start < free:  # overlaps what has been replaced
            free = max(free, end)
            continue
        out.append(text[free:start])
        out.append(f"[{KINDS[kind].upper()}]" if kind < 4 else "" if start in removed else _tag(text[start:end]))
        free = end
    return "".join([*out, text[free:]])


def _places(raw: np.ndarray, known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, code points where they start and where they end, of those that known() keeps."""
    kept = []
    for h, start, end in term_blocks(raw):
        h = h.view(np.int64)
        hit = known(h)
        if hit.any():
            kept.append((h[hit], start[hit], end[hit]))
    if not kept:
        return (np.empty(0, np.int64),) * 3
    h, start, end = (np.concatenate(c) for c in zip(*kept, strict=True))
    return h, code_points(raw, start), code_points(raw, end)


def _filtered(sent):
    """Places of terms that the filter lets pass, for texts (text, k1, k2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        right = np.uint64(64 - int(len(words)).bit_length() + 1)

        def known(h: np.ndarray) -> np.ndarray:
            u = h.view(np.uint64)
            mask = np.uint64(1) << (u & np.uint64(63)) | np.uint64(1) << (u >> np.uint64(6) & np.uint64(63))
            return words[(u >> right).astype(np.int64)] & mask == mask

        for batch in batches:
            parts = [np.empty((5, 0), np.int64)]
            for text, k1, k2 in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                h, start, end = _places(as_bytes(text), known)
                parts.append(np.stack((np.full(len(h), k1), np.full(len(h), k2), h, start, end)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(parts, axis=1)], names=["k1", "k2", "term", "start", "end"])

    return run


def _joined(docs: DataFrame, terms: DataFrame, n: int, scratch: Scratch, text_col: str) -> DataFrame:
    """(k1, k2, found): the revealing terms' places in each different text that has any, where the terms are many."""
    power = min(FILTER, max(1, int(n * 16 // 64).bit_length()))
    one = F.lit(1).cast("long")
    bit = lambda k: F.call_function("shiftleft", one, F.shiftright("term", k).bitwiseAND(F.lit(63)).cast("int"))
    bits = terms.groupBy(F.shiftrightunsigned("term", 64 - power).alias("at")).agg(F.bit_or(bit(0).bitwiseOR(bit(6))).alias("bits")).toArrow()
    words = np.zeros(1 << power, np.uint64)
    words[bits.column("at").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast(words)
    places = _keyed(docs, text_col).mapInArrow(_filtered(sent), "k1 long, k2 long, term long, start long, end long").distinct()
    places = scratch.write(places, "places")
    hits = places.join(terms, "term").groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end", (F.col("share") >= REMOVE).alias("removed"))).alias("found"))
    return scratch.write(hits, "found")


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))


def _judge(text_col: str, found_col: str | None, sent, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, shares = sent.value if sent is not None else (np.empty(0, np.int64),) * 2

        def known(h: np.ndarray) -> np.ndarray:
            return hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h

        for batch in batches:
            at = batch.schema.names.index(text_col)
            given = batch.column(batch.schema.names.index(found_col)).to_pylist() if found_col else None
            spans_out, texts = [], []
            for n, value in enumerate(batch.column(at)):
                text = value.as_py()
                spans, removed = base_spans(text) if text else [], set()
                if given and given[n]:
                    spans += [(f["start"], 4, f["end"]) for f in given[n]]
                    removed = {f["start"] for f in given[n] if f["removed"]}
                elif text and len(hashes):
                    h, start, end = _places(as_bytes(value), known)
                    spans += [(a, 4, b) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                    removed = set(start[shares[np.searchsorted(hashes, h)] >= REMOVE].tolist())
                spans.sort()
                spans_out.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
                if with_text:
                    texts.append(rewrite(text, spans, removed) if spans else text)
            columns = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != found_col]
            if with_text:
                columns[at] = (text_col, pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays([*(c for _, c in columns), pa.array(spans_out, _SPANS)], names=[*(n for n, _ in columns), "pii_spans"])

    return run


def sanitise(docs: DataFrame, support: float = SUPPORT, least: float = GENERALISE, with_text: bool = True, held: int = HELD, text_col: str = "text") -> DataFrame:
    """docs with its text rewritten, and pii_spans: array of (start, kind, end) in code points of the old text.

    A null text has no spans and stays null. Ids are not looked at, so they may repeat or be null; repeated
    rows count as documents of their own. Every other column stays as it is, whatever its name, but for one
    named pii_spans, which is replaced. with_text=False leaves the text as it is. Spans are in order of start and
    kind (see KINDS). More than held revealing terms are joined instead of being sent to every task.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    docs = docs.drop("pii_spans")
    terms = revealing_terms(docs, scratch, support, least, text_col)
    schema = ", ".join([docs.schema.toDDL(), "pii_spans array<struct<start: long, kind: int, end: long>>"])
    n = terms.count()
    if n <= held:
        got = terms.toArrow()
        order = np.argsort(got.column("term").to_numpy())
        sent = docs.sparkSession.sparkContext.broadcast(tuple(got.column(c).to_numpy()[order] for c in ("term", "share"))) if n else None
        return docs.mapInArrow(_judge(text_col, None, sent, with_text), schema)
    k1, k2, found = fresh(docs.columns, "k1", "k2", "found")
    places = _joined(docs, terms, n, scratch, text_col).select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("found").alias(found))
    d = docs.withColumns({k1: F.xxhash64(text_col), k2: F.xxhash64(F.lit(1), text_col)}).join(places, [k1, k2], "left")
    return d.select(*docs.columns, found).mapInArrow(_judge(text_col, found, None, with_text), schema)


def spelled(spans) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
