"""Archives: an exact round trip, assembly of partners in either direction, awkward pages."""

from __future__ import annotations

import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from plumbline.llm import warc

PAGES = "page_id long, url string, html string"
ROWS = [
    (1, "http://a/1", "<p>same</p>"),
    (2, "http://a/2", "<p>same</p>"),
    (9, "http://a/9", "<p>same</p>"),
    (3, "http://b", None),
    (4, None, ""),
    (5, "http://c\r\nWARC-Type: fake", "ends\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
    (6, "http://d", "Ünïcode 日本   \x00 \n\n"),
    (7, "http://e", "x" * 3_000_000),
    (None, "http://f", "no id"),
    (8, "http://g", "twice"),
    (8, "http://g", "twice"),
    (-5, "http://h", "negative"),
]


def sha1(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_pages_come_back_whole(spark, tmp_path):
    frame = spark.createDataFrame(ROWS, PAGES).withColumn("digest", F.lit(1)).withColumn("stored", F.lit("clash"))
    path = str(tmp_path / "archives")
    warc.write_archives(frame, path, records_per_file=5)
    records = warc.read_archives(spark, path)
    assert records.count() == 3 * len(ROWS)
    rows = warc.assemble(records).collect()
    assert len(rows) == len(ROWS)
    assert all(r["request"] and r["metadata"] and r["response"] for r in rows)
    payloads = {}
    for r in rows:
        if r["response"]["type"] == "response":
            page = bytes(r["metadata"]["payload"]).decode().strip()
            payloads[page] = bytes(r["response"]["payload"]).decode()
            assert r["response"]["digest"] == "sha1:" + sha1(payloads[page])
    assert payloads["page-id: 7"] == "x" * 3_000_000 and payloads["page-id: 5"] == ROWS[5][2]
    assert payloads["page-id: 6"] == ROWS[6][2] and payloads["page-id: 9"] == "<p>same</p>" and payloads[""] == "no id"
    assert "page-id: 1" not in payloads


def test_digests_of_all_pages(spark):
    rows = warc.page_digests(spark, spark.createDataFrame(ROWS, PAGES)).collect()
    assert len(rows) == len(ROWS)
    largest: dict = {}
    for page, _, html in ROWS:
        largest[html or ""] = max(largest.get(html or "", -100), -100 if page is None else page)
    by = {r["page_id"]: r for r in rows}
    for page, _, html in ROWS:
        r, top = by[page], largest[html or ""]
        assert (r["payload_bytes"], r["payload_digest"]) == (len((html or "").encode()), sha1(html))
        first = page is None or page == top
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first else ("revisit", top))


def test_partners_named_by_the_response_and_orphans(spark):
    rows = [
        ("r1", "response", ["q1"]),
        ("q1", "request", []),
        ("m1", "metadata", ["r1"]),
        ("r2", "response", []),
        ("q3", "request", ["gone"]),
        ("q4", "request", []),
        ("i", "warcinfo", []),
    ]
    records = spark.createDataFrame(rows, "record_id string, type string, concurrent_to array<string>")
    got = {
        r["capture_id"]: tuple(r[k] and r[k]["record_id"] for k in ("response", "request", "metadata"))
        for r in warc.assemble(records).collect()
    }
    assert got == {
        "r1": ("r1", "q1", "m1"), "r2": ("r2", None, None), "gone": (None, "q3", None), "q4": (None, "q4", None)
    }


def test_archives_of_others_are_read(tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: response\r\nwarc-record-id: <a>\r\nWARC-Concurrent-To: <b>\r\nWARC-Concurrent-To: <c>\r\n"
    record += b"Content-Type: application/http\r\nContent-Length: 27\r\n\r\nHTTP/1.1 200 OK\r\nA: b\r\n\r\nhi\r\n\r\n"
    members = b"".join(gzip.compress(record) for _ in range(3))
    for content in (record * 3, members):
        found = list(warc._parsed(content))
        assert [r["payload"] for r in found] == [b"hi"] * 3
        assert found[0]["concurrent_to"] == ["<b>", "<c>"] and found[0]["head"].startswith("HTTP/1.1 200")


def test_no_pages(spark):
    assert warc.page_digests(spark, spark.createDataFrame([], PAGES)).isEmpty()


def test_rows_of_a_hot_payload_are_split(spark, tmp_path):
    # Longer than a block of the shuffle's compression, so that it is large in the shuffle too.
    hot = "".join(hashlib.md5(str(i).encode()).hexdigest() for i in range(1500))
    text = F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.concat(F.md5(F.col("id").cast("string")), F.col("id") % 900))
    pages = spark.range(900, numPartitions=12).select(F.col("id").alias("page_id"), F.lit("http://a").alias("url"), text.alias("html"))
    pages = pages.unionByName(pages.where("page_id % 3 > 0").withColumn("page_id", F.col("page_id") + 900)).repartition(12)
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1000000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1000000",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        path = str(tmp_path / "archives")
        warc.write_archives(pages, path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    files = spark.read.format("binaryFile").load(path).select("content").collect()
    sizes = [sum(1 for _ in warc._parsed(bytes(f["content"]))) for f in files]
    assert sum(sizes) == 3 * 1500
    assert sum(size > 0 for size in sizes) >= 5
    records = warc.read_archives(spark, path)
    kinds = {r["type"]: r["count"] for r in records.groupBy("type").count().collect()}
    assert kinds["response"] == 601 and kinds["revisit"] == 899
