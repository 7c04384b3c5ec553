"""Legacy ARC archives turned into WARC archives, and both read and written.

ARC is read as its version says: a version block names the fields of the
header lines, and every record's length is declared. From these lines come the
WARC record ids, dates, types and digests. Archives are written as gzip files
by Spark and read as binary files; a file is one task's share of the table.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved

#: The fields of a header line, by the version of the format.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_KEY = "X-Page-Id"
_DATE = "20240101000000"
_IDS = uuid.UUID("5f2c7a1e-0d3b-5c46-9a77-3b1f0c2d4e68")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_record(version: int, url: str, key: int | None, payload: bytes) -> bytes:
    """A header line, an HTTP response with the key in a field of its own, a line end."""
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{_KEY}: {'' if key is None else key}\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode() + payload
    address = quote(url, safe="!#$%&'()*+,/:;=?@[]~") or "-"
    more = ["200", digest(payload), "-", "0", "-"] if version == 2 else []
    line = " ".join([address, "0.0.0.0", _DATE, "text/html", *more, str(len(http))])
    return line.encode() + b"\n" + http + b"\n"


def arc_version_block(version: int) -> bytes:
    body = f"{version} 0 converter\n{ARC_FIELDS[version]}\n".encode()
    more = ["200", "-", "-", "0", "-"] if version == 2 else []
    line = " ".join(["filedesc://pages.arc", "0.0.0.0", _DATE, "text/plain", *more, str(len(body))])
    return line.encode() + b"\n" + body + b"\n"


def _lines_of(data: io.BufferedIOBase) -> Iterator[bytes]:
    """Lines that aren't empty; None of a record's body passes here."""
    while line := data.readline():
        if line.strip():
            yield line.rstrip(b"\r\n")


def read_arc(data: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and body of each record; one that the file's end cuts short is left out.

    Header fields are counted from the right, since old crawlers left spaces in
    addresses.
    """
    lines = _lines_of(data)
    first = next(lines, None)
    if first is None:
        return
    length = int(first.rsplit(b" ", 1)[1])
    names = data.read(length).decode().split("\n")[1].split()
    for line in lines:
        values = line.decode("utf-8", "replace").rsplit(" ", len(names) - 1)
        fields = dict(zip(names, values))
        size = int(values[-1])
        body = data.read(size)
        if len(body) == size:
            yield fields, body


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """The HTTP header of a response, with its empty line, and the payload."""
    head, line, payload = body.partition(b"\r\n\r\n")
    return (head + line, payload) if line else (b"", body)


def _field(name: str, head: bytes) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace") if found else None


def record_id(key: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_IDS, f'{key} {payload_digest}')}>"


def warc_record(fields: dict, head: bytes, payload: bytes, refers_to: tuple | None) -> bytes:
    """A response record, or a revisit of ``refers_to`` (its key) with the HTTP header alone.

    The record's last two line ends are left to the writer.
    """
    stamp = fields["date"]
    date = f"{stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:14]}Z"
    block = head if refers_to else head + payload
    lines = [
        "WARC/1.0",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: {record_id(fields['key'], fields['digest'])}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {fields['url']}",
        f"WARC-IP-Address: {fields['ip']}",
        f"WARC-Payload-Digest: sha1:{fields['digest']}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to:
        lines += [
            f"WARC-Refers-To: {record_id(refers_to[0], fields['digest'])}",
            f"Refers-To-Key: {refers_to[0]}",
            "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest",
        ]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def read_warc(data: io.BufferedIOBase) -> Iterator[tuple[bytes, bytes]]:
    """Header and block of each record, by declared lengths."""
    for line in _lines_of(data):
        head = [line]
        while (line := data.readline()).strip():
            head.append(line.rstrip(b"\r\n"))
        header = b"\n".join(head)
        size = int(_field("Content-Length", header) or 0)
        block = data.read(size)
        if len(block) == size:
            yield header, block


def write_arc(pages: DataFrame, path: str, version: int = 1) -> None:
    """One record per page (page_id, url, html), a file per task, each with its version block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [arc_version_block(version)]
        for batch in batches:
            for key, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                rows.append(arc_record(version, url, key, html.as_buffer().to_pybytes()))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])
            rows = []

    given = pages.select(
        "page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html")
    )
    records = given.mapInArrow(run, "value binary")
    records.select(F.col("value").cast("string")).write.option("lineSep", "\n").option("compression", "gzip").text(path)


def archive_rows(spark: SparkSession, path: str, reader, row, schema: str) -> DataFrame:
    """Rows that ``row`` makes of the records that ``reader`` finds in a folder's gzip files."""
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[part.split()[1]] for part in schema.split(", ")]

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                with gzip.open(io.BytesIO(content.as_buffer())) as data:
                    for record in reader(io.BufferedReader(data, 1 << 20)):
                        rows.append(row(*record))
                        held += len(record[1])
                        if held > 1 << 23:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, schema)


def arc_to_warc(spark: SparkSession, arc: str, warc: str) -> None:
    """Converts a folder of ARC archives.

    Of records with equal payloads the one with the smallest key is a response
    (a record without a key comes last), the others are revisits of it. The
    digests are grouped apart; payloads move once, to the join with the groups,
    whose large ones the adaptive planner splits.
    """

    def row(fields: dict, body: bytes) -> tuple:
        head, payload = split_http(body)
        key = _field(_KEY, head)
        return (
            int(key) if key else None, fields["URL"], fields["IP-address"], fields["Archive-date"],
            digest(payload), head, payload,
        )

    schema = "key long, url string, ip string, date string, digest string, head binary, payload binary"
    records = archive_rows(spark, arc, read_arc, row, schema)
    firsts = records.groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Written first, so that both sides of the join are dealt anew and can be split.
    firsts = saved(firsts.select("digest", "first"), "digests")
    joined = records.join(firsts, "digest", "left")
    names = joined.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for values in zip(*(column.to_pylist() for column in batch.columns)):
                fields = dict(zip(names, values))
                first = fields["first"]
                revisit = (first,) if first is not None and first != fields["key"] else None
                rows.append(warc_record(fields, fields["head"], fields["payload"], revisit))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])

    values = joined.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    values.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", 50_000).text(warc)


def read_pages(spark: SparkSession, warc: str) -> DataFrame:
    """``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type`` and
    ``refers_to`` of each response and revisit of a folder of WARC archives.

    A response's payload is digested anew; a digest that differs fails the job.
    """

    def row(header: bytes, block: bytes) -> tuple:
        head, payload = split_http(block)
        kind, declared = _field("WARC-Type", header), _field("WARC-Payload-Digest", header).removeprefix("sha1:")
        if kind == "response" and digest(payload) != declared:
            raise ValueError("a record's payload differs from its digest")
        key, refers_to = _field(_KEY, head), _field("Refers-To-Key", header)
        size = len(payload) if kind == "response" else int(_field("Content-Length", head))
        return int(key) if key else None, size, declared, kind, int(refers_to) if refers_to else None

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return archive_rows(spark, warc, read_warc, row, schema)


#: The same result in the checking database's SQL.
SQL = """
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, unhex(sha1(coalesce(html, ''))) AS raw
  FROM pages),
bits AS (
  SELECT *, array_to_string(list_transform(range(1, 21), lambda i:
    lpad(bin(CAST('0x' || hex(array_slice(raw, i, i)) AS INTEGER)), 8, '0')), '') AS b
  FROM hashed),
coded AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_reduce(list_transform(range(1, 6), lambda j:
      CAST(substr(b, 5 * k + j, 1) AS INTEGER)), lambda x, y: 2 * x + y) AS INTEGER), 1)), '') AS payload_digest
  FROM bits),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM coded)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts"""
