"""Language identification by Bayesian fusion of four kinds of evidence.

The posterior of a language is its prior on the host, times the likelihood of the text, of the declared
markup language and of the address suffix. Text likelihoods come from byte trigrams; one class more, with
equal likelihood for every trigram, stands for text in no known language. Host priors are smoothed from
level to level: a host towards its domain, the domain towards the whole corpus. Their counts are sums over
all rows of what each row's own evidence says, by grouped aggregation; a row's own share is taken out
before its prior is formed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, small

UNKNOWN = "und"
#: Classes of trigrams.
BUCKETS = 1 << 15
#: Trigrams of one text depend on each other: so much of their log-likelihood counts.
TEMPER = 0.3
#: Probability that a declared language, and that a country's suffix, is right.
DECLARED, SUFFIX = 0.9, 0.7
#: Rows that a host's prior, and a domain's, borrow from the level above; prior of the unknown language.
BORROW, UNKNOWN_PRIOR = 20.0, 0.01
#: A row is accepted from this posterior on.
ACCEPT = 0.5
#: Rows of the labelled sample that a model is fitted on, about.
SAMPLE = 4000
#: Languages of country suffixes, where one prevails.
SUFFIXES = {"at": "de", "de": "de", "li": "de", "ar": "es", "cl": "es", "co": "es", "es": "es", "mx": "es", "pe": "es", "uy": "es", "fr": "fr", "sn": "fr", "au": "en", "ie": "en", "nz": "en", "uk": "en", "us": "en", "it": "it", "nl": "nl", "pt": "pt", "br": "pt", "pl": "pl"}

_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


def trigrams(text: str) -> np.ndarray:
    """Bucket of each trigram of the letters' bytes; what stands between words counts as one space."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)
    letter = _LETTER[raw]
    keep = letter | np.concatenate(([True], letter[:-1]))
    b = np.where(letter, raw, np.uint8(32))[keep].astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    code = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1)
    return (code >> np.uint32(17)).astype(np.int64)


@dataclass
class Model:
    """Log-likelihoods of trigrams: a column for each language, the last for the unknown one."""

    languages: tuple[str, ...]
    table: np.ndarray

    def text(self, text: str | None) -> tuple[np.ndarray, int]:
        """Tempered log-likelihood of the text in each class, and its number of trigrams."""
        grams = trigrams(text) if text else ()
        if not len(grams):
            return np.zeros(len(self.languages) + 1), 0
        return TEMPER * self.table[grams].sum(0, dtype=np.float64), len(grams)

    def said(self, language: str | None, right: float) -> np.ndarray:
        """Log-likelihood of a declaration that is right with the given probability; nothing if it is unknown."""
        n = len(self.languages)
        code = re.split(r"[-_]", language.strip().lower())[0] if language else ""
        if code not in self.languages:
            return np.zeros(n + 1)
        out = np.full(n + 1, np.log((1 - right) / n))
        out[self.languages.index(code)] = np.log(right)
        out[n] = np.log(1 / n)
        return out


def posterior(log: np.ndarray) -> np.ndarray:
    p = np.exp(log - log.max())
    return p / p.sum()


def _gram_counts(languages: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if label in languages and (text := text.as_py()):
                    count[languages.index(label)] += np.bincount(trigrams(text), minlength=BUCKETS)
        lang, gram = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(gram.astype(np.int32)), pa.array(count[lang, gram])], names=["lang", "gram", "n"])

    return run


def fit(labelled: DataFrame, languages: tuple[str, ...], label_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model fitted on about sample rows of the labelled ones, chosen by a hash of id and text.

    The counts that come to the driver are at most len(languages) * BUCKETS. Without labelled rows every
    language has the same likelihoods.
    """
    point = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = labelled.where(point < sample / max(1, labelled.count())).select(F.lower(F.col(label_col)).alias("lang"), F.col(text_col).alias("text"))
    counts = rows.mapInArrow(_gram_counts(languages), "lang int, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((BUCKETS, len(languages)), 0.5)
    table[counts.column("gram").to_numpy(), counts.column("lang").to_numpy()] += counts.column("n").to_numpy()
    table = np.log(table / table.sum(0))
    return Model(languages, np.column_stack((table, np.full(BUCKETS, -np.log(BUCKETS)))).astype(np.float32))


def _own(model: Model, text, declared, suffix) -> tuple[np.ndarray, int]:
    """What the row itself says, before any prior."""
    log, n = model.text(text)
    return log + model.said(declared, DECLARED) + model.said(SUFFIXES.get((suffix or "").lower()), SUFFIX), n


def _flat(n: int) -> np.ndarray:
    return np.log(np.append(np.full(n, (1 - UNKNOWN_PRIOR) / n), UNKNOWN_PRIOR))


def _host_counts(model_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of.value
        width = len(model.languages) + 1
        for batch in batches:
            total: dict = {}
            for text, host, domain, declared, suffix in zip(batch.column(0), *(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                log, n = _own(model, text.as_py(), declared, suffix)
                if n:
                    # whole thousandths, so that sums don't depend on their order
                    total.setdefault((domain, host), np.zeros(width, np.int64))[:] += np.rint(1000 * posterior(log + _flat(width - 1))).astype(np.int64)
            keys = list(total)
            counts = np.array([total[k] for k in keys], np.int64).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), *(pa.array(counts[:, i]) for i in range(width))], names=["domain", "host", *(f"c{i}" for i in range(width))])

    return run


def fused(own: np.ndarray, mine: np.ndarray, levels: list[np.ndarray], has_text: bool) -> np.ndarray:
    """The posterior: levels are counts from the whole corpus down to the host; mine is the row's own share of each."""
    prior = np.exp(_flat(len(own) - 1))
    for count in levels:
        rest = np.maximum(count - (mine if has_text else 0), 0)
        prior = (rest + BORROW * prior) / (rest.sum() + BORROW)
    return posterior(own + np.log(prior))


def _judge(model_of, total: list[int], text_col: str, evidence: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of.value
        names = [*model.languages, UNKNOWN]
        flat = _flat(len(model.languages))
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            rows = []
            small_columns = [batch.column(at[c]).to_pylist() for c in evidence]
            for text, declared, suffix, host, domain in zip(batch.column(at[text_col]), *small_columns, strict=True):
                own, n = _own(model, text.as_py(), declared, suffix)
                mine = np.rint(1000 * posterior(own + flat)) / 1000
                levels = [np.array(c) / 1000 if c else np.zeros(len(names)) for c in (total, domain, host)]
                p = fused(own, mine, levels, n > 0)
                k = int(p.argmax())
                kept = n > 0 and names[k] != UNKNOWN and p[k] >= ACCEPT
                rows.append((names[k] if n else UNKNOWN, float(round(p[k], 9)), kept))
            keep = [i for i, c in enumerate(batch.schema.names) if c not in evidence]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.bool_())],
                names=[*(batch.schema.names[i] for i in keep), "language", "confidence", "accepted"],
            )

    return run


def identify(rows: DataFrame, model: Model, text_col: str = "text", host: Column | None = None, declared: Column | None = None, suffix: Column | None = None, domain: Column | None = None) -> DataFrame:
    """rows with language, confidence and accepted.

    host, declared, suffix and domain say where the evidence is; of those left out there is none. Null or empty evidence says nothing. A text without letters is of the unknown language, and not accepted.
    Rows may repeat; all columns stay, whatever their names, but those with the names of results are replaced.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "language")
    rows = rows.drop("language", "confidence", "accepted")
    nothing = F.lit(None).cast("string")
    of_host, of_domain, said, ending, host_counts, domain_counts = fresh([*rows.columns, text_col], "host", "domain", "declared", "suffix", "host_counts", "domain_counts")
    evidence = [F.coalesce(nothing if host is None else host, F.lit("")).alias(of_host), F.coalesce(nothing if domain is None else domain, F.lit("")).alias(of_domain), (nothing if declared is None else declared).alias(said), (nothing if suffix is None else suffix).alias(ending)]
    width = len(model.languages) + 1
    columns = [f"c{i}" for i in range(width)]
    sent = spark.sparkContext.broadcast(model)
    counts = rows.select(text_col, *evidence).mapInArrow(_host_counts(sent), ", ".join(["domain string", "host string", *(f"{c} long" for c in columns)]))
    hosts = scratch.write(counts.groupBy("domain", "host").agg(*[F.sum(c).alias(c) for c in columns]), "hosts")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns]
    total = np.array(hosts.agg(*sums).first(), np.int64)
    domains = hosts.where("domain <> ''").groupBy("domain").agg(*sums).select(F.col("domain").alias(of_domain), F.array(*columns).alias(domain_counts))
    domains = scratch.write(domains, "domains")
    hosts = hosts.where("host <> ''").select(F.col("domain").alias(of_domain), F.col("host").alias(of_host), F.array(*columns).alias(host_counts))
    e = rows.select("*", *evidence)
    e = e.join(small(hosts, 64 + 8 * width), [of_domain, of_host], "left").join(small(domains, 64 + 8 * width), of_domain, "left")
    given = [said, ending, host_counts, domain_counts]
    e = e.select(*rows.columns, *given)
    ddl = ", ".join([rows.schema.toDDL(), "language string, confidence double, accepted boolean"])
    return e.mapInArrow(_judge(sent, total.tolist(), text_col, given), ddl)
