"""Media columns: interleaved sequences of texts and media, aligned with stored payloads.

Parsing a page yields its texts and media references in order, each with its position, and with the
caption of its figure. Media are stored under the digest of what they hold, each row's by the task that reads
the row; equal payloads are equal rows there, and have one row of facts. References meet their media in a join by
digest; facts that need a payload (features, checks) are computed where it is stored, so that the join moves
digests and facts and not payloads, unless they are asked for. Facts are a written table, and references are dealt
out by digest alone, so that Spark can split a digest that very many references share.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh
from .markup import BLOCK, VOID, Stack, attributes, tokens

#: A picture's row, and rows of which a payload holds a multiple: 24 x 24 samples.
WIDTH, PAD = 24, 576
_DIGEST = re.compile(r"(?<![0-9a-f])[0-9a-f]{64}(?![0-9a-f])")
_SILENT = frozenset("script style template noscript title head".split())
_MEDIA = frozenset("img video audio source embed".split())


# ---------------------------------------------------------------- stored form: 8-bit grey PNG


def payload_of(text: str | None) -> bytes:
    """The text's UTF-8 bytes, filled with 255 to a positive multiple of 576."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * ((-len(raw)) % PAD if raw else PAD)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: bytes, width: int = WIDTH) -> bytes:
    """samples, a positive multiple of width, as a lossless 8-bit grey picture."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)  # each line starts with filter 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of a picture that encode_png() made."""
    at, data, width = 8, [], 0
    while at < len(media):
        (size,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            (width,) = struct.unpack_from(">I", body)
        elif kind == b"IDAT":
            data.append(body)
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)
    if lines[:, 0].any():
        raise ValueError("only filter 0 is read")
    return lines[:, 1:].tobytes()


def feature(samples: bytes, width: int = WIDTH) -> str:
    """Mean and deviation, a histogram of 16 levels in thousandths, and 64 bits of the picture shrunk to 8 x 8."""
    a = np.frombuffer(samples, np.uint8)
    level = np.bincount(a >> 4, minlength=16) * 1000 // len(a)
    rows = a.reshape(-1, width)
    edges = np.linspace(0, len(rows), 9).astype(int)[:-1]
    small = np.add.reduceat(rows.reshape(-1, 8, width // 8).sum(2, dtype=np.int64), edges, axis=0) / np.diff(np.append(edges, len(rows)))[:, None]
    bits = np.packbits(small > small.mean()).tobytes().hex()
    return f"{a.mean():.3f};{a.std():.3f};{','.join(map(str, level))};{bits}"


# ---------------------------------------------------------------- operators

_STORED = "digest string, media binary"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            payloads = [payload_of(t.as_py()) for t in batch.column(0).slice(at, 200)]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(p).hexdigest() for p in payloads]), pa.array([encode_png(p) for p in payloads], pa.binary())], names=["digest", "media"])


def store_texts(docs: DataFrame, scratch: Scratch, text_col: str = "text") -> DataFrame:
    """digest, media: the written pictures of the texts, under the digests of what they hold."""
    return scratch.write(docs.select(text_col).mapInArrow(_store, _STORED), "media")


_FACTS = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            rows = []
            for digest, media in zip(batch.column(0).slice(at, 200).to_pylist(), batch.column(1).slice(at, 200), strict=True):
                media = media.as_py()
                p = decode_png(media)
                rows.append((digest, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(p)))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _FACTS.split(", ")])


def media_facts(media: DataFrame, scratch: Scratch) -> DataFrame:
    """The written table of one row for each digest: what the stored bytes give when they are read back."""
    facts = media.select("digest", "media").mapInArrow(_read, _FACTS)
    return scratch.write(facts.groupBy("digest").agg(*[F.min(c).alias(c) for c in facts.columns if c != "digest"]), "facts")


_ITEMS = "array<struct<position: int, kind: string, text: string, ref: string, digest: string, caption: string>>"
_ITEM_TYPE = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))


def items_of(html: str | None) -> list[dict]:
    """The texts and media references of a page in order; a figure's caption goes to its media."""
    items: list[dict] = []
    stack, parts, figure = Stack(), [], None

    def text_ends():
        line = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if not line:
            return
        if "figcaption" in stack.names and figure is not None:
            figure["caption"] = f"{figure['caption'] or ''} {line}".strip()
        else:
            items.append({"kind": "text", "text": line, "ref": None, "digest": None, "caption": None})

    def figure_ends():
        nonlocal figure
        if figure is not None:
            for item in items[figure["from"] :]:
                if item["kind"] == "media" and figure["caption"]:
                    item["caption"] = figure["caption"]
        figure = None

    for kind, name, text in tokens(html or ""):
        if kind == "text":
            if not _SILENT & set(stack.names):
                parts.append(text)
            continue
        if name in BLOCK or name in _MEDIA:
            text_ends()
        elif name == "br":
            parts.append(" ")
        if kind == "close":
            stack.closed(name)
            if name == "figure":
                figure_ends()
            continue
        stack.opened(name)
        if name == "figure":
            figure_ends()
            figure = {"from": len(items), "caption": None}
        if name in _MEDIA:
            a = attributes(text)
            if ref := a.get("src"):
                digest = _DIGEST.search(a.get("data-digest", "")) or _DIGEST.search(ref)
                items.append({"kind": "media", "text": None, "ref": entities.unescape(ref), "digest": digest[0] if digest else None, "caption": entities.unescape(a["alt"]) if a.get("alt") else None})
        if name not in VOID:
            stack.push(name, None)
    text_ends()
    figure_ends()
    for n, item in enumerate(items):
        item["position"] = n
    return items


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The html comes last and is replaced by its items."""
    for batch in batches:
        for start in range(0, batch.num_rows, 200):
            part = batch.slice(start, 200)
            got = pa.array([items_of(h.as_py()) for h in part.column(part.num_columns - 1)], _ITEM_TYPE)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], got], names=[*part.schema.names[:-1], "items"])


def interleave(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without its html, with items: the ordered texts and media references of each page.

    A null or empty html has no items. Every other column stays, but for one named items, which is
    replaced. References without a digest keep a null one and meet no media.
    """
    own = [c for c in pages.columns if c not in (html_col, "items")]
    p = pages.select(*own, F.col(html_col).alias(fresh(own, "html")[0]))
    return p.mapInArrow(_parse, ", ".join([*([p.select(*own).schema.toDDL()] if own else []), f"items {_ITEMS}"]))


def resolve(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """A row for each media reference of the sequences, with its position, caption and the columns of its media.

    media has a row for each digest: media_facts(), or the stored payloads themselves. References whose
    digest is null or not stored get nulls. Columns of the sequences named n_items, position, ref, caption or digest
    are replaced; columns of media that the sequences have too are left out.
    """
    own = [c for c in sequences.columns if c not in ("items", "n_items", "position", "ref", "caption", "digest")]
    (item,) = fresh(own, "item")
    refs = sequences.select(*own, F.size("items").alias("n_items"), F.explode(F.filter("items", lambda i: i["kind"] == "media")).alias(item))
    refs = refs.select(*own, "n_items", *[F.col(item)[c].alias(c) for c in ("position", "ref", "caption", "digest")])
    return refs.join(media.select("digest", *[c for c in media.columns if c not in refs.columns]), "digest", "left")


def _page(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            ids, sizes, pages = batch.column(0).slice(at, 200), [], []
            for doc_id, text in zip(ids.to_pylist(), batch.column(1).slice(at, 200), strict=True):
                text = text.as_py() or ""
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                digest = hashlib.sha256(payload_of(text)).hexdigest()
                lines = "".join(f"<p>{entities.escape(line)}</p>" for line in text.split("\n"))
                pages.append(f'<article>{lines}<figure><img src="media/{digest}.png"><figcaption>{doc_id}</figcaption></figure></article>')
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(pages, pa.string())], names=["doc_id", "n_bytes", "html"])


def illustrated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, html: each document as a page that shows its text and refers to its picture."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_page, "doc_id long, n_bytes long, html string")
