"""Web archives: writing captures as WARC records and assembling them again.

A capture is written as three records: a response (or a revisit, if its payload is stored
with another capture), the request and a metadata record with the page id; the latter two
name the first in WARC-Concurrent-To. Records are plain text, so Spark's own text writer
commits the archives, with the two line ends between records as its separator; the files
are gzip streams. Reading parses the archives by Content-Length, however payloads look.

Assembly joins requests and metadata to responses through the concurrent-to identifiers (in
either direction) and emits one nested row per capture; records whose partner is missing are
kept, as captures without a response.

Which payloads are equal is told by SHA-1. The largest page id of a digest is combined before the
shuffle; the rows of a hot payload, with their text, are split among tasks by Spark's skew handling.

Cases: a NULL payload is empty, a NULL url is empty; line ends in a url are written
as %0D and %0A. Of equal payloads with one page id, the largest url is the response. Rows
repeated in all of page_id, url and payload give one capture each, all of them responses or
all revisits. Empty tables give empty archives. Other records (warcinfo) are passed over.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, new_folder

DATE = "2024-01-01T00:00:00Z"
RECORDS_PER_FILE = 6000
_EOL = "\r\n"
_KINDS = ("response", "revisit")

RECORD = (
    "record_id string, type string, uri string, concurrent_to array<string>, refers_to string, "
    "digest string, content_type string, head string, payload binary"
)
_RECORD = pa.schema(
    [
        ("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()),
        ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("digest", pa.string()),
        ("content_type", pa.string()), ("head", pa.string()), ("payload", pa.binary()),
    ]
)


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32 without padding: every five hex digits are four of base 32."""
    digest = F.sha1(payload)
    quads = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*quads), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(kind: str, page: Column, url: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), page.cast("string"), digest, url).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(headers: list[tuple[str, Column | None]], block: Column) -> Column:
    """One record without the separator behind it; headers with a NULL value are left out."""
    lines = [F.lit("WARC/1.1" + _EOL)]
    for name, value in [*headers, ("Content-Length", F.octet_length(block).cast("string"))]:
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_EOL)), F.lit("")))
    return F.concat(*lines, F.lit(_EOL), block)


def write_archives(pages: DataFrame, path: str, date: str = DATE, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Three records for each row of (page_id, url, html) into gzip archives under ``path``."""
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        url.alias("url"),
        html.alias("html"),
        base32_sha1(html.cast("binary")).alias("digest"),
    )
    # A written table of the payloads that occur twice: both sides of the join are then shuffled right
    # before it, so a payload that a third of all pages hold is split among tasks.
    stored = rows.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("stored"), F.count(F.lit(1)).alias("copies"))
    stored = materialize(stored.where("copies > 1").drop("copies"))
    rows = rows.join(stored, "digest", "left")
    same = F.col("page_id").eqNullSafe(F.col("stored.page_id")) & (F.col("url") == F.col("stored.url"))
    here = F.col("stored").isNull() | same
    own, other = F.col("page_id"), F.col("stored.page_id")
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=UTF-8{_EOL}Content-Length: "),
        F.octet_length("html").cast("string"),
        F.lit(_EOL + _EOL),
    )
    capture = _record_id("capture", own, F.col("url"), F.col("digest"))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    response = _record(
        [
            ("WARC-Type", F.when(here, "response").otherwise("revisit")),
            ("WARC-Record-ID", capture),
            *common,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Profile", F.when(~here, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("WARC-Refers-To", F.when(~here, _record_id("capture", other, F.col("stored.url"), F.col("digest")))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(here, F.concat(head, "html")).otherwise(head),
    )
    request = _record(
        [
            ("WARC-Type", F.lit("request")),
            ("WARC-Record-ID", _record_id("request", own, F.col("url"), F.col("digest"))),
            *common,
            ("WARC-Concurrent-To", capture),
            ("Content-Type", F.lit("application/http; msgtype=request")),
        ],
        F.concat(F.lit("GET "), "url", F.lit(f" HTTP/1.1{_EOL}{_EOL}")),
    )
    metadata = _record(
        [
            ("WARC-Type", F.lit("metadata")),
            ("WARC-Record-ID", _record_id("metadata", own, F.col("url"), F.col("digest"))),
            *common,
            ("WARC-Concurrent-To", capture),
            ("Content-Type", F.lit("application/warc-fields")),
        ],
        F.coalesce(F.concat(F.lit("page-id: "), own.cast("string"), F.lit(_EOL)), F.lit("")),
    )
    rows.select(F.explode(F.array(request, response, metadata)).alias("value")).write.option(
        "lineSep", _EOL + _EOL
    ).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _parsed(content: bytes) -> Iterator[dict]:
    """The records of one archive, read one by one."""
    raw = io.BytesIO(content)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw, 1 << 16)
    while True:
        line = stream.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        headers: dict[str, list[str]] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("an archive ends within a record's headers")
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        length = int(headers["content-length"][0])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("an archive ends within a record")
        one = lambda name: headers.get(name, [None])[0]  # noqa: B023, E731
        http = (one("content-type") or "").startswith("application/http")
        head, _, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
        yield {
            "record_id": one("warc-record-id"), "type": one("warc-type"), "uri": one("warc-target-uri"),
            "concurrent_to": headers.get("warc-concurrent-to", []), "refers_to": one("warc-refers-to"),
            "digest": one("warc-payload-digest"), "content_type": one("content-type"),
            "head": head.decode("utf-8", "replace"), "payload": payload,
        }


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records under ``path``: ids, type, links, digest, HTTP head and payload.

    A task holds its archive files compressed and a few MB of records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                for record in _parsed(batch.column(0)[i].as_py()):
                    rows.append(record)
                    held += len(record["payload"])
                    if held > 4_000_000 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, _RECORD)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _RECORD)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, request and metadata.

    ``records`` has record_id, type, concurrent_to and any columns more; each of the three
    structs holds all of them. Read it from a written table without payloads if they are not
    needed, as it is read once for each kind.
    """
    row = F.struct(*records.columns)
    main = records.where(F.col("type").isin(*_KINDS))
    other = records.where(F.col("type").isin("request", "metadata"))
    named = other.select(F.explode("concurrent_to").alias("capture_id"), "type", row.alias("record"))
    links = main.select(F.col("record_id").alias("capture_id"), F.explode("concurrent_to").alias("record_id"))
    back = links.join(other.select("record_id", "type", row.alias("record")), "record_id")
    # A partner that names nothing and that nothing names is a capture of its own.
    alone = other.where(F.size("concurrent_to") == 0).join(links.select("record_id").distinct(), "record_id", "left_anti")
    partners = (
        named.unionByName(back.select("capture_id", "type", "record"))
        .unionByName(alone.select(F.col("record_id").alias("capture_id"), "type", row.alias("record")))
        .groupBy("capture_id")
        .agg(
            F.max(F.when(F.col("type") == "request", F.col("record"))).alias("request"),
            F.max(F.when(F.col("type") == "metadata", F.col("record"))).alias("metadata"),
        )
    )
    return main.select(F.col("record_id").alias("capture_id"), row.alias("response")).join(partners, "capture_id", "full_outer")


def page_digests(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes the pages as archives in the shared folder, reads them back, and reports every capture."""
    path = new_folder(spark, "warc")
    write_archives(pages, path)
    records = read_archives(spark, path)
    slim = materialize(
        records.select(
            "record_id",
            "type",
            "concurrent_to",
            "refers_to",
            F.when(F.col("type") == "response", base32_sha1(F.col("payload")))
            .otherwise(F.regexp_replace("digest", "^sha1:", ""))
            .alias("digest"),
            F.octet_length("payload").cast("long").alias("bytes"),
            F.when(F.col("type") == "metadata", F.regexp_extract(F.col("payload").cast("string"), r"page-id: (-?\d+)", 1)).alias(
                "page"
            ),
        )
    )
    captures = assemble(slim).select(
        "capture_id",
        F.expr("try_cast(metadata.page as long)").alias("page_id"),
        F.col("response.type").alias("record_type"),
        F.col("response.refers_to").alias("refers_to"),
        F.col("response.bytes").alias("bytes"),
        F.col("response.digest").alias("digest"),
    )
    targets = (
        captures.where("record_type = 'response'")
        .groupBy(F.col("capture_id").alias("refers_to"))
        .agg(F.max("page_id").alias("target"), F.max("bytes").alias("target_bytes"))
    )
    return captures.join(targets, "refers_to", "left").select(
        "page_id",
        F.coalesce("target_bytes", "bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        F.col("target").alias("refers_to"),
    )
