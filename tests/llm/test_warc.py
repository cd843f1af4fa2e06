import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from quire.llm import warc

ROWS = [(1, "http://www.example.com/a?x=1", "<p>same</p>", 9), (2, "https://b.example.com:8080/a b\n", "<p>same</p>", 9),
        (3, "http://example.org/é", None, 9), (4, None, "", 9), (5, "http://example.org/é", "own é 漢", 9),
        (6, "not a url", "<p>same</p>", 9), (7, "http://u:p@h.net", "A" * 3_000_000, 9), (7, "http://u:p@h.net", "A" * 3_000_000, 9),
        (None, "http://x.y", "<p>same</p>", 9), (None, "http://x.z", "nameless", 9)]
ROWS += [(i, "http://hot.example.com/", f"page {i % 40}", 9) for i in range(100, 1500)]
SCHEMA = "page_id long, url string, html string, digest int"


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    pages = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    return pages, warc.write_archive(pages, f"file:{tmp_path_factory.mktemp('a')}/w"), tmp_path_factory


def expected(rows, least=0):
    out = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        same = [j for j, _, h, _ in rows if (h or "") == (html or "") and j is not None]
        first = max(same, default=None) if len(data) >= least else i
        refers = first if first is not None and i != first else None
        out.append((None if i is None else str(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "response" if refers is None else "revisit", None if refers is None else str(refers)))
    return sorted(out, key=str)


def as_rows(records):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records), key=str)


def test_round_trip(spark, archive):
    pages, written, _ = archive
    keys = pages.select(warc.surt(F.col("url")).alias("key"))
    records = warc.read_records(spark, written, warc.lookup(spark, written, keys)).collect()
    assert as_rows(records) == expected(ROWS) and all(r.sound for r in records)
    html = {str(i): (h or "").encode() for i, _, h, _ in ROWS if i is not None}
    assert all(r.payload == html[r.page_id] for r in records if r.record_type == "response" and r.page_id is not None)


def test_lookup_of_single_keys(spark, archive):
    _, written, _ = archive
    key = lambda url: spark.range(1).select(warc.surt(F.lit(url)).alias("key")).first()[0]
    assert key("http://www.Example.com/a?x=1") == "com,example,www)/a?x=1"
    for url, ids in [("http://example.org/é", {"3", "5"}), ("http://hot.example.com/", {str(i) for i in range(100, 1500)}),
                     ("http://nowhere.example/", set()), ("zzz", set()), ("", {"4"})]:
        keys = spark.createDataFrame([(key(url),), (key(url),), (None,)], "key string")
        assert {r.page_id for r in warc.lookup(spark, written, keys).collect()} == ids


def test_least_bytes_and_empty(spark, archive):
    pages, _, folders = archive
    written = warc.write_archive(pages, f"{folders.mktemp('b')}/w", least_bytes=9)
    keys = pages.select(warc.surt(F.col("url")).alias("key"))
    assert as_rows(warc.read_records(spark, written, warc.lookup(spark, written, keys)).collect()) == expected(ROWS, 9)
    none = warc.write_archive(pages.filter("false"), f"{folders.mktemp('c')}/w")
    assert none.shards == () and warc.read_records(spark, none, warc.lookup(spark, none, keys)).count() == 0


def test_ids_of_text_and_payloads_that_share_a_sha1(spark, tmp_path):
    """A null id is not the text ``None``; payloads are told apart by more than SHA-1 and length."""
    pages = spark.createDataFrame([("None", "http://a.b/", "x"), (None, "http://a.c/", "y"), ("", "http://a.d/", "z"), (None, None, "")],
                                  "page_id string, url string, html string")
    written = warc.write_archive(pages, f"{tmp_path}/w")
    keys = pages.select(warc.surt(F.col("url")).alias("key"))
    records = warc.read_records(spark, written, warc.lookup(spark, written, keys)).collect()
    assert sorted(((r.page_id, r.payload) for r in records), key=str) == sorted(
        [("None", b"x"), (None, b"y"), ("", b"z"), (None, b"")], key=str)
    plan = warc.with_responses(pages, "page_id", "url", "html", 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2(" in plan and "sha1(" in plan


def test_shards_are_bounded(spark, archive, monkeypatch, tmp_path):
    """With few shards allowed they grow, and every capture is still found."""
    pages, written, _ = archive
    monkeypatch.setattr(warc, "ROWS_PER_SHARD", 100)
    monkeypatch.setattr(warc, "MOST_SHARDS", 3)
    captures = spark.read.schema(warc.CAPTURE).parquet(f"{written.folder}/captures")
    shards = warc.write_index(captures, f"file:{tmp_path}/i")
    assert 1 < len(shards) <= 3
    other = warc.Archive(f"file:{tmp_path}/i", shards)
    keys = pages.select(warc.surt(F.col("url")).alias("key"))
    assert warc.lookup(spark, other, keys).count() == len(ROWS)
