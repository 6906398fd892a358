"""WARC archives: writing captures, reading records back, and assembling transactions.

A capture is three records: a request, a response (or a revisit of an equal payload
stored before) and metadata; request and metadata name the response's record id in
WARC-Concurrent-To. Archives are written by Spark's text sink, one record a row, the
records' closing blank lines as its separator, gzip over each file. A file holds at most
FILE_RECORDS records, and fewer where pages are large, so that it stays below FILE_BYTES. Files
are unpacked as a stream, record by record, by Content-Length alone.

Transaction assembly brings the records of a capture together by their concurrent-to
identifier (a response's own id) in one shuffle and emits a nested row per capture. A capture that has
lost its request or metadata is kept; one without response has nulls for what is lost.

Cases: null html is an empty payload; of equal payloads that of the largest page_id is
the response (of rows that repeat that page_id, the first by url); payloads under
`revisit_bytes` are all responses; a null page_id is kept, and isn't revisited; a null url
leaves out WARC-Target-URI; control characters and spaces in a url are percent-encoded; an
empty table gives an empty archive; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

END = "\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"
FILE_RECORDS, FILE_BYTES = 20_000, 1 << 30
#: Rows and bytes of payloads that a reader hands on at a time.
ROWS, ROW_BYTES = 2000, 8 << 20
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
SPACE_OF_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(kind: str, page_id: int | None, digest: str, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_OF_IDS, f'{kind}:{page_id}:{digest}:{nth}')}>"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(headers: list[tuple[str, str | None]], block: str) -> str:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block.encode())}"]
    return "\r\n".join(lines) + END + block


def _uri(url: str | None) -> str | None:
    return None if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url)


def request_block(url: str | None) -> str:
    """The request for a URL: its path and query, and its host where it has one."""
    try:
        parts = urlsplit(_uri(url) or "")
    except ValueError:
        parts = urlsplit("")
    target = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"GET {target} HTTP/1.1\r\n" + (f"Host: {parts.netloc}\r\n" if parts.netloc else "") + "\r\n"


def captures(pages: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, html, digest (hexadecimal SHA-1), nth, holder: the page that a revisit refers to, null for responses."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    keys = own.where(F.col("page_id").isNotNull() & (F.octet_length("html") >= revisit_bytes)).groupBy("page_id", "digest").count()
    holders = keys.groupBy("digest").agg(F.max("page_id").alias("holder"), F.sum("count").alias("n")).where("n > 1")
    equal = keys.join(holders, "digest").select("page_id", "digest", "holder")
    nth = F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("url"))
    joined = own.join(equal, ["page_id", "digest"], "left").withColumn("nth", nth)
    return joined.withColumn("holder", F.when((F.col("holder") != F.col("page_id")) | (F.col("nth") > 1), F.col("holder")))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            page, digest, nth = r["page_id"], r["digest"], r["nth"]
            revisit = r["holder"] is not None
            main = record_id("capture", page, digest, nth)
            shared = [("WARC-Date", DATE), ("WARC-Target-URI", _uri(r["url"])), ("X-Page-ID", None if page is None else str(page))]
            about = [("WARC-Concurrent-To", main), *shared]
            sha1 = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
            out.append(_record([("WARC-Type", "request"), ("WARC-Record-ID", record_id("request", page, digest, nth)), *about, ("Content-Type", "application/http; msgtype=request")], request_block(r["url"])))
            head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", main), *shared, ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", sha1)]
            if revisit:
                head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id("capture", r["holder"], digest, 1))]
            out.append(_record(head, HTTP + ("" if revisit else r["html"])))
            out.append(_record([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", page, digest, nth)), *about, ("Content-Type", "application/warc-fields")], f"nth: {nth}\r\n"))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


def write_archive(pages: DataFrame, folder: str, revisit_bytes: int = 0) -> None:
    records = captures(pages, revisit_bytes).select("page_id", "url", "html", "digest", "nth", "holder").mapInArrow(_records, "value string")
    largest = pages.agg(F.max(F.octet_length(F.col("html").cast("string")))).first()[0] or 0
    most = max(1, min(FILE_RECORDS, 3 * FILE_BYTES // (largest + 4096)))  # of a capture's three records one holds the page
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", most).text(folder)


def parse(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an unpacked archive, one record in memory at a time."""
    nth = 0
    while first := stream.readline():
        nth += 1
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record in place {nth}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[name.lower()] = value
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {nth} doesn't end as its length says")
        yield headers, block


RECORDS = "record_type string, record_id string, capture string, refers_to string, uri string, page_id long, payload_digest string, payload_bytes long, http_headers string, payload binary"


def read_archive(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """A row per record. Digests and sizes are taken from the payloads, and an archive whose digests differ is refused.

    Payloads of responses are kept as zstd frames, so that the shuffle of the assembly moves little; payload_text unpacks them.
    """

    names = [field.split()[0] for field in RECORDS.split(", ")]

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in ("page_id", "payload_bytes") else pa.binary() if n == "payload" else pa.string()) for n, c in zip(names, zip(*rows))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for h, block in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                    head, _, body = block.partition(b"\r\n\r\n")
                    packed = pack(body) if with_payload and h["warc-type"] == "response" else None
                    kind, digest, size = h["warc-type"], None, None
                    if kind == "response":
                        digest, size = base32_sha1(body), len(body)
                        if h["warc-payload-digest"] != "sha1:" + digest:
                            raise ValueError(f"{h['warc-record-id']}: the payload doesn't match its digest")
                    elif kind == "revisit":
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                    page = h.get("x-page-id")
                    rows.append((kind, h["warc-record-id"], h.get("warc-concurrent-to", h["warc-record-id"]), h.get("warc-refers-to"), h.get("warc-target-uri"), None if page is None else int(page), digest, size, head.decode(), packed))
                    held += len(packed or b"")
                    if len(rows) >= ROWS or held >= ROW_BYTES:
                        yield told(rows)
                        rows, held = [], 0
                if rows:
                    yield told(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(folder).select("content")
    return files.mapInArrow(run, RECORDS)


@F.pandas_udf(StringType())
def payload_text(payloads: pd.Series) -> pd.Series:
    """The text of a record's payload; null stays null."""
    unpack = zstandard.ZstdDecompressor().decompress
    return payloads.map(lambda x: unpack(x).decode(), na_action="ignore")


def assemble(records: DataFrame) -> DataFrame:
    """A nested row per capture: capture (the response's id), response (or revisit), request and metadata."""
    parts = [n for n in records.columns if n != "capture"]
    one = lambda *kinds: F.max(F.when(F.col("record_type").isin(*kinds), F.struct(*parts)))
    return records.groupBy("capture").agg(one("response", "revisit").alias("response"), one("request").alias("request"), one("metadata").alias("metadata"))


def resolved(transactions: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and the URI of each capture; revisits take the size from their response."""
    known = lambda name: F.coalesce(F.col(f"response.{name}"), F.col(f"request.{name}"), F.col(f"metadata.{name}")).alias(name)
    r = transactions.select("response.record_id", known("page_id"), known("uri"), "response.payload_bytes", "response.payload_digest", "response.record_type", F.col("response.refers_to").alias("target"))
    revisits = r.where("record_type = 'revisit'").drop("payload_bytes")
    responses, lost = r.where("record_type = 'response'"), r.where("record_type is null")
    found = revisits.join(responses.select(F.col("record_id").alias("target"), "payload_bytes", F.col("page_id").alias("refers_to")), "target", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri"]
    alone = responses.unionByName(lost).withColumn("refers_to", F.lit(None).cast("long"))
    return alone.select(columns).unionByName(found.select(columns))
