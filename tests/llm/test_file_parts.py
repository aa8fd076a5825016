"""Token files and bundles: hot ids, edge ids, repeated rows and reading by ranges."""

import hashlib

from pyspark.sql import functions as F

from abacist.llm import token_files, warc_bundles
from abacist.llm.queries import tokenizer_file


def test_a_hot_id_fills_several_parts(spark, monkeypatch):
    monkeypatch.setattr(token_files, "PART_BYTES", 2_000)
    least = -(2**63)
    rows = [(5, "same words in every row")] * 900 + [(5, f"text {i}") for i in range(50)] + [(9, "z"), (least, "low"), (None, "none"), (None, None), (-1, "b")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, h int, n string").repartition(7)
    manifest = token_files.write(docs, tokenizer_file("byte_bpe_50k.json"), 2)
    parts = manifest.orderBy("part").collect()
    assert len(parts) >= 8 and max(p["n_docs"] for p in parts) < 500
    got = token_files.read(manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, least, -1, *[5] * 950, 9]
    ends = [r["start"] + r["n_tokens"] for r in got]
    assert [r["start"] for r in got] == [0, *ends[:-1]]


def test_repeated_pages_and_small_runs_of_frames(spark, monkeypatch):
    monkeypatch.setattr(warc_bundles, "FRAME_BYTES", 600)
    monkeypatch.setattr(warc_bundles, "BUNDLE_FRAMES", 8)
    monkeypatch.setattr(warc_bundles, "READ_FRAMES", 2)
    rows = [(i % 40, "http://a.b/", "page " * (i % 11), "x") for i in range(200)] + [(None, None, "page ", "y"), (7, None, None, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = warc_bundles.read(warc_bundles.write(pages)).collect()
    first: dict[str, int] = {}
    for i, _, html, _ in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    of = {warc_bundles.base32_sha1((h or "").encode()): h or "" for _, _, h, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        html = of[r["payload_digest"]]
        assert r["payload_bytes"] == len(html)
        revisit = r["page_id"] != first[html]
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[html]) if revisit else ("response", None))


def test_payloads_with_one_sha1(spark, monkeypatch):
    """Two payloads of one digest and length are told apart by the second hash."""
    pages = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "page_id long, html string")
    made = pages.select("page_id", F.lit("0" * 40).alias("digest"), F.lit(1).alias("n_bytes"), F.xxhash64("html").alias("second"))
    assert [r["first"] for r in warc_bundles.firsts(made).collect()] == [1]
    assert hashlib.sha1(b"a").hexdigest() == spark.sql("SELECT sha1('a')").first()[0]
