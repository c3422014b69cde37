"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import CHAT_SQL, TRICKY, format_chats, read_back
from .circulant_minhash import near_duplicates
from .common import Scratch, table
from .conversation_repair import damage, repair
from .cover_tree import close_vectors
from .filter_audit import AUDIT_SQL, audit
from .html_paths import extract
from .language import fit, identify
from .licenses import scan_licenses
from .media import illustrated, interleave, media_facts, resolve, store_texts
from .mixing import MIX_SQL, mix
from .packing import pack
from .pii import KINDS, sanitise, spelled
from .small_world import nearest


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license templates that every document holds."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the tricky one, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = F.array(*[F.struct(F.lit(c).cast("long").alias("conv_id"), F.lit(n).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(text).alias("text")) for c, n, role, text in TRICKY])
    tricky = spark.range(1).select(F.inline(rows))
    return read_back(format_chats(turns.unionByName(tricky)))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 1024 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, vocabulary("byte_bpe_50k.json"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "host", "path")


#: Languages that the corpus is labelled with.
LANGUAGES = ("de", "en", "es", "fr")


def identify_documents(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """docs with language, confidence and accepted: the source is the host, lang the declared language."""
    return identify(docs, fit(labelled, LANGUAGES), host=F.col("source"), declared=F.col("lang"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; kept says whether it is accepted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return identify_documents(docs, docs).select("doc_id", "language", "confidence", F.col("lang").alias("declared"), F.col("source").alias("host"), F.col("accepted").alias("kept"))


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page, with all four kinds of evidence; the model is fitted on the documents."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    declared = F.regexp_extract("html", r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([a-z-]+)", 1)
    found = extract(pages.withColumn("declared", declared))
    parts = F.split("host", r"\.")
    domain = F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), F.lit(2)), ".")
    got = identify(found, fit(table(spark, sf_dir, "documents"), LANGUAGES), host=F.col("host"), declared=F.col("declared"), suffix=F.element_at(parts, -1), domain=domain)
    return got.select("page_id", "host", "declared", "language", "confidence", "accepted")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored picture of every document, met from the reference in the document's page."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scratch = Scratch(spark, "media")
    facts = media_facts(store_texts(docs, scratch), scratch)
    found = resolve(interleave(illustrated(docs)), facts)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "n_items")


def op8_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return close_vectors(table(spark, sf_dir, "embeddings"))


def op9_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of every document, and the terms that reveal it."""
    found = sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    base = F.filter("pii_spans", lambda s: s["kind"] < 4)

    def count(kind: int):
        return F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(k) for k in range(5)]
    return found.select("doc_id", *counts, F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("pii_spans")).alias("spans"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from every source in each of their orders."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return audit(docs.select("doc_id", "text", "source"), labels.select("doc_id", "quality", "toxic"))


def op12_small_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth one."""
    return nearest(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by the key of each row, with the cheapest edits that repair them."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair(damage(turns), turns)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_licenses": op2_licenses,
        "op3_chat": op3_chat,
        "op4_packing": op4_packing,
        "op5_html": op5_html,
        "op6_language": op6_language,
        "language_of_pages": language_of_pages,
        "op7_media": op7_media,
        "op8_cover_tree": op8_cover_tree,
        "op9_circulant_minhash": op9_circulant_minhash,
        "op10_pii": op10_pii,
        "op11_filter_audit": op11_filter_audit,
        "op12_small_world": op12_small_world,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": MIX_SQL, "op3_chat": CHAT_SQL, "op11_filter_audit": AUDIT_SQL}
