import hashlib
import random
import zlib

from pyspark.sql import functions as F

from cuelattice.llm.common import Scratch
from cuelattice.llm.media import decode_png, encode_png, illustrated, interleave, items_of, media_facts, payload_of, resolve, store_texts

from .common import EDGES, edges, empty


def test_round_trip():
    r = random.Random(2)
    for n in (0, 1, 575, 576, 577, 5000, 60_000):
        text = "".join(chr(r.choice([65, 233, 20320, 128512, 10])) for _ in range(n))
        p = payload_of(text)
        raw = text.encode()
        assert len(p) % 576 == 0 and len(p) > 0 and p[: len(raw)] == raw and set(p[len(raw) :]) <= {255}
        assert decode_png(encode_png(p)) == p
    assert payload_of(None) == b"\xff" * 576


def test_interleaved_order_and_captions():
    d = "0" * 63 + "a"
    html = f'<p>one<img src="m/{d}.png" alt="alt &amp; one">two</p><figure><video src=v.mp4></video><img src=x.png><figcaption>The <b>cap</b></figcaption></figure><p>three<script>no</script>'
    got = [(i["position"], i["kind"], i["text"] or i["ref"], i["caption"], i["digest"]) for i in items_of(html)]
    assert got == [(0, "text", "one", None, None), (1, "media", f"m/{d}.png", "alt & one", d), (2, "text", "two", None, None), (3, "media", "v.mp4", "The cap", None), (4, "media", "x.png", "The cap", None), (5, "text", "three", None, None)]
    assert items_of(None) == items_of("") == []


def test_documents_meet_their_pictures(spark):
    d = edges(spark, digest="x", items="y", media="z")
    found = resolve(interleave(illustrated(d)), media_facts(store_texts(d, Scratch(spark, "test")), Scratch(spark, "test"))).collect()
    assert len(found) == len(EDGES)
    want = {}
    for i, text, *_ in EDGES:
        p = payload_of(text)
        want.setdefault(i, []).append((len((text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    got = {}
    for r in found:
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32))
        assert r.caption == str(r.doc_id)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    e = empty(spark)
    assert resolve(interleave(illustrated(e)), media_facts(store_texts(e, Scratch(spark, "test")), Scratch(spark, "test"))).count() == 0


def test_other_columns_and_missing_media(spark):
    pages = spark.createDataFrame([(1, "a", '<img src="x.png"><p>t</p>'), (None, None, None), (1, "a", '<img src="x.png"><p>t</p>')], "page_id long, digest string, html string").withColumn("items", F.lit(1))
    got = interleave(pages)
    assert got.columns == ["page_id", "digest", "items"]
    clash = pages.withColumnsRenamed({"html": "body"}).withColumns({c: F.lit(c) for c in ("html", "position", "ref", "caption", "item", "n_items")})
    seen = resolve(interleave(clash, html_col="body"), spark.createDataFrame([("0" * 64, 5)], "digest string, payload_bytes long"))
    assert [(r.page_id, r.html, r.position, r.item) for r in seen.collect()] == [(1, "html", 0, "item")] * 2
    media = spark.createDataFrame([("0" * 64, 5)], "digest string, payload_bytes long")
    refs = resolve(got.drop("digest"), media).collect()
    assert [(r.page_id, r.position, r.payload_bytes) for r in refs] == [(1, 0, None)] * 2
