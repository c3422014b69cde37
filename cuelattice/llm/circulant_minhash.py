"""Near-duplicate documents by circulant MinHash.

Two permutations make the whole signature: the first scatters a document's shingles, the second,
shifted by k places around its circle, gives coordinate k. Both are bijections of 32-bit numbers that
need no table. Bands of five coordinates propose pairs, and the full shingle sets decide.

How the work stays in proportion to the input:

* documents with equal sets become one class before any banding;
* in a bucket, each class is first compared with the bucket's least class only, and components are
  built from those links;
* a few rounds more compare the classes of other components with one class of the bucket chosen at random,
  another one in each bucket and round;
* classes of one bucket that are then still in different components are compared with each other inside the
  join, by the signature's bits and then by a larger sketch that only these classes have; of buckets with the
  same classes one is kept, each pair is met in its first common bucket only, and only pairs that pass go on to the
  exact comparison.

So no link between components is lost to the stars, and a group of thousands of copies costs thousands
of comparisons.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, digest128, mix64, shingle_set, small
from .components import connected_components

#: 38 bands of 5: a pair of similarity 0.75 shares none with probability 3e-5, one of 0.8 with 3e-7.
BANDS, ROWS = 38, 5
#: Coordinates of the signature; the lowest bit of each is kept for a quick estimate.
COORDINATES = 192
#: Bits that agree at least. A pair of similarity 0.75 agrees in 168 of 192, with a deviation of 4.6:
#: fewer have one in a million.
AGREE = 146
#: Rounds of stars around random classes at most.
ROUNDS = 2
#: Lanes of four bits of the larger sketch, and the deviations from similarity 0.75 that it lets pass.
LANES, DEVIATIONS = 1024, 5.0
_BLOCK = 512


def signature(shingles: np.ndarray) -> np.ndarray:
    """The 192 coordinates: the least value of the shifted second permutation over the scattered set."""
    shift = np.arange(COORDINATES, dtype=np.uint32)
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(shingles), _BLOCK):
        x = shingles[i : i + _BLOCK]
        x = (x ^ (x >> np.uint64(32))).astype(np.uint32)
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        y = x[:, None] - shift
        y *= np.uint32(0x9E3779B1)
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        y ^= y >> np.uint32(12)
        y *= np.uint32(0x297A2D39)
        np.minimum(least, y.min(axis=0), out=least)
    return least


def _band_keys(least: np.ndarray) -> np.ndarray:
    rows = least[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for i in range(ROWS):
        key = (key ^ rows[:, i]) * np.uint64(0x9FB21C651E98DF25)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64())), ("s0", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())])
_SIGNED_DDL = "doc_id long, text_key long, k1 long, k2 long, n long, bands array<long>, s0 long, s1 long, s2 long"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: OrderedDict = OrderedDict()  # the last few sets, as copies come often
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            rows = []
            for doc_id, text, own in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist(), strict=True):
                s = shingle_set(text)
                if not len(s):
                    rows.append((doc_id, own, 0, 0, 0, None, 0, 0, 0))
                    continue
                key = digest128(s)
                if key not in known:
                    least = signature(s)
                    bits = np.packbits((least & np.uint32(1)).astype(np.uint8)).view(np.int64)
                    known[key] = (_band_keys(least), *map(int, bits))
                    if len(known) > 2000:
                        known.popitem(last=False)
                rows.append((doc_id, own, *key, len(s), *known[key]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SIGNED)], schema=_SIGNED)


#: Shingles of the sets that a task keeps for the pairs to come.
_KEPT = 1 << 21


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets have a similarity of 75 in 100 at least."""
    sets: OrderedDict = OrderedDict()
    held = 0

    def of(node, text):
        nonlocal held
        if node not in sets:
            sets[node] = shingle_set(text)
            held += len(sets[node])
            while held > _KEPT and len(sets) > 2:
                held -= len(sets.popitem(last=False)[1])
        sets.move_to_end(node)
        return sets[node]

    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        keep = []
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            p, q = of(x, batch.column(2)[i]), of(y, batch.column(3)[i])
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(100 * both >= 75 * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([pa.array([v for v, k in zip(s, keep, strict=True) if k], pa.int64()) for s in (a, b)], names=["src", "dst"])


def _texts(docs: DataFrame, named: DataFrame, cids: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(cid, text) of the classes: the text of each one's own document, which may come in repeated rows."""
    wanted = scratch.write(named.join(cids.distinct(), "cid", "left_semi"), f"{name}-ids").withColumnsRenamed({"doc_id": "id", "text_key": "key"})
    both = docs.join(small(wanted, 40), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")))
    return both.groupBy("cid").agg(F.first("text").alias("text"))


def _verified(docs: DataFrame, named: DataFrame, pairs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Those of the written pairs (src, dst) that the full texts confirm."""
    ids = pairs.select(F.col("src").alias("cid")).distinct().unionByName(pairs.select(F.col("dst").alias("cid")).distinct())
    texts = scratch.write(_texts(docs, named, ids, scratch, name), f"{name}-texts")
    a = texts.select(F.col("cid").alias("src"), F.col("text").alias("src_text"))
    b = texts.select(F.col("cid").alias("dst"), F.col("text").alias("dst_text"))
    both = pairs.join(a, "src").join(b, "dst").select("src", "dst", "src_text", "dst_text")
    return scratch.write(both.mapInArrow(_judge, "src long, dst long"), f"{name}-links")


def _close(a: str, b: str) -> F.Column:
    """Sizes that allow the similarity, and bits that agree enough."""
    agree = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(1, 3)), F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))))
    return (4 * F.least(f"{a}.n", f"{b}.n") >= 3 * F.greatest(f"{a}.n", f"{b}.n")) & (agree <= COORDINATES - AGREE)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """1024 lanes, 16 in a number: 0 for a lane that no shingle falls in, else 1 to 15 from the least that does."""
    x = mix64(shingles ^ np.uint64(0x5851F42D4C957F2D))
    lane = (x & np.uint64(LANES - 1)).astype(np.int64)
    least = np.full(LANES, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, lane, x >> np.uint64(10))
    value = np.where(np.bincount(lane, minlength=LANES) > 0, mix64(least) % np.uint64(15) + np.uint64(1), np.uint64(0))
    return (value.reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(1, dtype=np.uint64).view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [sketch(shingle_set(t)) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tolist() for x in got], pa.list_(pa.int64()))], names=["cid", "sketch"])


def _filled(x: F.Column) -> F.Column:
    """How many of a number's 16 lanes are not 0."""
    x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
    return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))


def _alike(a: str, b: str) -> F.Column:
    """Whether the sketches allow the similarity.

    Of the E lanes filled in either, those that differ are at most a quarter, up to some deviations. Lanes are
    a sample without replacement of the union, which has (n + m) / 1.75 shingles at similarity 0.75.
    """

    union = (F.col(f"{a}.n") + F.col(f"{b}.n")) / 1.75

    def allowed(counts: F.Column) -> F.Column:
        either, differ = F.shiftright(counts, 16), counts.bitwiseAND(F.lit(65535))
        left = F.greatest(1 - either / union, F.lit(0.0)) + 0.02
        return differ <= 0.25 * either + DEVIATIONS * F.sqrt(0.1875 * either * left) + 3

    # both counts in one number, so that the sketches are read once
    both = F.zip_with(f"{a}.sketch", f"{b}.sketch", lambda x, y: 65536 * _filled(x.bitwiseOR(y)) + _filled(x.bitwiseXOR(y)))
    return F.aggregate(both, F.lit(0), lambda s, v: s + v, allowed)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_group: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs; with_group adds text_key and group.

    Links hold between sets of five-word shingles of similarity 0.75 or more. A text of fewer words is
    one shingle; a text without words, or null, has an empty set, links with nothing and is its own
    component. component_id is the least id reachable, kept says whether it is the row's own. Rows are told
    apart by id and text: repeated equal rows get equal results, different texts of one id are judged each
    by itself. A row without id takes part by its text; its component is null if no id is reachable, and kept is
    false. text_key is a number for the text, and group one for the component, null where the set is empty. Other
    columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    signed = scratch.write(docs.mapInArrow(_sign, _SIGNED_DDL), "signed")
    least = F.min_by(F.struct("doc_id", "text_key", "n", "bands", "s0", "s1", "s2"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))
    classes = signed.where("n > 0").groupBy("k1", "k2").agg(least.alias("c"))
    classes = scratch.write(classes.select(F.monotonically_increasing_id().alias("cid"), "k1", "k2", "c.*"), "classes")
    named = classes.select("cid", "doc_id", "text_key")
    traits = classes.select("cid", "n", "s0", "s1", "s2")

    # buckets of two classes at least
    placed = classes.select("cid", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("cid").alias("head"), F.count("*").alias("m")).where("m > 1")
    shared = scratch.write(shared.select("bucket", "head"), "buckets")
    members = scratch.write(placed.join(shared, "bucket").select("bucket", "cid", "head"), "members")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        a, b = traits.alias("a"), traits.alias("b")
        pairs = pairs.join(a, F.col("src") == F.col("a.cid")).join(b, F.col("dst") == F.col("b.cid")).where(_close("a", "b")).select("src", "dst")
        return _verified(docs, named, scratch.write(pairs, name), scratch, name)

    # the star of each bucket around its least class
    links = confirmed(members.where("cid <> head").select(F.col("cid").alias("src"), F.col("head").alias("dst")).distinct(), "star")
    members = members.select("bucket", "cid")
    for k in range(ROUNDS + 1):
        roots = connected_components(links, scratch)
        rooted = scratch.write(members.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("bucket", "cid", F.coalesce("root", "cid").alias("root")), "rooted")
        # buckets with more than one component, and a class of each by chance
        chosen = F.min_by(F.struct("cid", "root"), F.xxhash64("cid", "bucket", F.lit(k)))
        split = rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), chosen.alias("c")).where("lo <> hi")
        split = scratch.write(split.select("bucket", F.col("c.cid").alias("head"), F.col("c.root").alias("head_root")), "split")
        members = scratch.write(rooted.join(split, "bucket"), "open")
        if k == ROUNDS:
            break
        star = members.where("root <> head_root").select(F.greatest("cid", "head").alias("src"), F.least("cid", "head").alias("dst")).distinct()
        found = confirmed(star, "chance")
        if found.isEmpty():
            break
        links = scratch.write(links.unionByName(found), "links")
        members = members.select("bucket", "cid")

    # what the stars have missed: pairs of one bucket in different components. Pages of one template fill many buckets
    # with the same classes: one of such buckets is enough
    who = F.xxhash64("cid")
    alike = members.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.shiftright(who, 16)).alias("x"), F.bit_xor(who).alias("y"))
    alike = scratch.write(alike.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket"), "different")
    members = scratch.write(members.join(alike, "bucket").select("bucket", "cid", "root"), "members")
    own = members.groupBy("cid").agg(F.sort_array(F.collect_list("bucket")).alias("own"))
    texts = _texts(docs, named, members.select("cid"), scratch, "open")
    sketches = scratch.write(texts.mapInArrow(_sketches, "cid long, sketch array<long>"), "sketches")
    more_traits = scratch.write(classes.select("cid", "n", "s0", "s1", "s2").join(sketches, "cid").join(own, "cid"), "traits")
    open_ = scratch.write(members.join(more_traits, "cid"), "traits")
    a, b = open_.alias("a"), open_.alias("b")
    first = F.element_at(F.array_intersect("a.own", "b.own"), 1) == F.col("a.bucket")
    same = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.cid") < F.col("b.cid")) & (F.col("a.root") != F.col("b.root")) & _close("a", "b")
    pairs = a.join(b, same & first & _alike("a", "b"))
    pairs = scratch.write(pairs.select(F.col("b.cid").alias("src"), F.col("a.cid").alias("dst")), "rest")
    more = _verified(docs, named, pairs, scratch, "rest")
    roots = connected_components(links.unionByName(more), scratch)

    rooted = scratch.write(classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("k1", "k2", "doc_id", F.coalesce("root", "cid").alias("group")), "roots")
    component = rooted.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    by_class = scratch.write(rooted.join(scratch.write(component, "components"), "group").select("k1", "k2", "group", "component_id"), "by-class")
    # the class key is made null where no class exists, so that such rows meet nothing
    out = signed.select("doc_id", "text_key", "n", F.when(F.col("n") > 0, F.col("k1")).alias("k1"), "k2").join(by_class, ["k1", "k2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    more = ["text_key", "group"] if with_group else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"), *more)
