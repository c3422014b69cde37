"""A training-data pipeline over documents: each stage calls one operator of cuelattice.llm.

Every stage works on all rows that the one before it kept; run() writes each stage's result as Parquet in
the cluster's shared folder and reads it again, so a lost executor costs part of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.llm.circulant_minhash import near_duplicates
from cuelattice.llm.common import Scratch, fresh, small, table
from cuelattice.llm.mixing import mix
from cuelattice.llm.packing import pack
from cuelattice.llm.pii import sanitise
from cuelattice.llm.queries import identify_documents, vocabulary

#: White space, and a word with what stands before it.
_WORD_AND_GAP = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def _aside(docs: DataFrame, *results: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns of results' names renamed, and how they are renamed back."""
    clashing = [c for c in docs.columns if c.lower() in results]
    names = dict(zip(clashing, fresh([*docs.columns, *results], *clashing), strict=True))
    return docs.withColumnsRenamed(names), {new: old for old, new in names.items()}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the known languages; the model is fitted on a bounded sample of the labelled table."""
    d, back = _aside(docs, "language", "confidence", "accepted")
    return identify_documents(d, table(spark, sf_dir, "documents")).where("accepted").select(d.columns).withColumnsRenamed(back)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the least id; texts without words all stay.

    Rows are told apart by id and text: different texts of one id are different documents, repeated rows one.
    """
    scratch = Scratch(spark, "deduplicate")
    found = scratch.write(near_duplicates(docs, with_group=True).select("doc_id", "text_key", "group"), "found")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    first = scratch.write(found.where("group is not null").groupBy("group").agg(F.min(key).alias("first")), "first")
    # each id and text once, with the number of its rows and whether it is the first of its group
    marks = found.join(first, "group", "left").groupBy("doc_id", "text_key").agg(F.count("*").alias("rows"), F.first("group").alias("group"), F.first(key == F.col("first")).alias("stays"))
    dropped = F.col("group").isNotNull() & ~F.col("stays")
    alone = F.col("group").isNull() & F.col("doc_id").isNull()
    marks = scratch.write(marks.where(dropped | ((F.col("rows") > 1) & ~alone)).select("doc_id", "text_key", dropped.alias("dropped")), "marks")
    own, (id_, text_key, key_of, mark) = docs.columns, fresh(docs.columns, "id", "text_key", "key_of", "dropped")
    d = docs.withColumn(text_key, F.xxhash64("text"))
    m = small(marks.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key_of), F.col("dropped").alias(mark)), 24)
    d = d.join(m, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(text_key) == F.col(key_of)), "left").where(~F.coalesce(mark, F.lit(False)))
    if marks.where("not dropped").isEmpty():
        return d.select(own)
    once = d.where(F.col(mark).isNotNull()).dropDuplicates(["doc_id", text_key])
    return d.where(F.col(mark).isNull()).select(own).unionByName(once.select(own))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data and the terms that reveal it generalised or removed."""
    d, back = _aside(docs, "pii_spans")
    return sanitise(d).withColumn("n_chars", F.length("text").cast("long")).select(d.columns).withColumnsRenamed(back)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the one at its source's cut with the words taken only."""
    d, back = _aside(docs, "size", "source_size", "target", "epochs", "taken")
    m = mix(d)
    full, rest, copy = fresh(m.columns, "full", "rest", "copy")
    m = m.withColumn(full, F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("long"))
    m = m.withColumn(rest, F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0))
    copies = F.col(full) + F.when(F.col(rest) > 0, 1).otherwise(0)
    m = m.where(copies > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(_WORD_AND_GAP), F.lit(0)), F.lit(1), F.col(rest).cast("int")), "")
    text = F.when(F.col(copy) <= F.col(full), F.col("text")).otherwise(part)
    return m.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(d.columns).withColumnsRenamed(back)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every piece of every document, and their place in sequences of 1024."""
    # the workers still hold what the stages before left them: fewer words are remembered than by packing alone
    return pack(docs, vocabulary("byte_bpe_50k.json"), with_ids=True, shard_docs=4000, known=150_000)


STAGES = [
    ("language", language),
    ("near_duplicates", deduplicate),
    ("pii", private),
    ("mixing", mixed),
    ("packing", packed),
]

#: No stage of statistics over words, MinHash or tokenizer ids can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
