"""Legacy archives to WARC: read ARC files, write WARC files, read those back.

:func:`write_arc` lays pages down as ARC files of version 1 or 2 (a version
block, then for each record a URL line and as many bytes as the line says).
:func:`read_arc` reads such files by the field names that each file's version
block declares.  :func:`to_warc` turns the records into WARC 1.1 records with
synthesised identifiers, dates, types and digests: of records with equal
payloads the one with the largest page id becomes the response, the others
become revisits of it.  :func:`read_warc` reads the archives back.

Files are written by Spark's text writer (one record a row, the record
separator as line separator) and read through its binary reader, so any
store that Spark reaches will do.  A file holds at most ``RECORDS_PER_FILE``
records.

Results for odd input: a null payload is empty; a null or blank URL becomes
``about:blank``, blanks and control characters in URLs are percent-encoded; a
record without page id is always a response, and none refers to it; of
repeated rows (same page id and payload) all are responses or all revisits;
an empty table gives empty archives and an empty result; other columns of the
input are not read.
"""

from __future__ import annotations

import base64
import datetime as dt
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmix.llm.common import arrow_schema, map_batches, materialize, scratch_path, table

RECORDS_PER_FILE = 5_000
# Rows of this many bytes go to Spark at a time.
BATCH_BYTES = 4_000_000

# The URL line's fields by ARC version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_END = b"\r\n\r\n"
EPOCH = dt.datetime(2020, 1, 1)
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:jobmix:warc")

LINE = arrow_schema({"value": pa.binary()})
INDEX = arrow_schema({"page_id": pa.int64(), "payload_digest": pa.string()})
RECORD = arrow_schema({"page_id": pa.int64(), "payload_digest": pa.string(), "url": pa.string(), "ip": pa.string(),
                       "date": pa.string(), "http": pa.binary(), "payload": pa.binary()})
READ = arrow_schema({"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
                     "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string(), "date": pa.string(),
                     "record_id": pa.string(), "refers_to_record": pa.string()})


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "about:blank"


def record_id(page_id: int | None, payload_digest: str, url: str) -> str:
    """A record's identifier; the same for the same page and payload, wherever it is worked out."""
    name = f"{page_id}:{payload_digest}" if page_id is not None else f"{url}:{payload_digest}"
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>"


def _batches(rows: Iterator[tuple], schema: pa.Schema, size_of) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += size_of(row)
        if size >= BATCH_BYTES or len(held) >= 4096:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)],
                                      schema=schema)


def _rows(batches, size: int = 256) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield from zip(*[c.to_pylist() for c in batch.slice(at, size).columns])


def _write(lines: DataFrame, path: str, separator: str, per_file: int) -> str:
    """Write binary rows as gzip files of at most ``per_file`` rows each."""
    (lines.selectExpr("cast(value as string) as value").write
     .option("lineSep", separator).option("compression", "gzip").option("maxRecordsPerFile", per_file)
     .option("zlib.compress.level", "BEST_SPEED").text(path))
    return path


def _with_heads(records: Iterator[bytes], head, per_file: int) -> Iterator[tuple[bytes]]:
    """A file's first record before every ``per_file - 1`` records, in step with the writer's files."""
    for n, record in enumerate(records):
        if n % (per_file - 1) == 0:
            yield (head(n // (per_file - 1)),)
        yield (record,)


# ---------------------------------------------------------------------------
# ARC
# ---------------------------------------------------------------------------

def arc_head(version: int) -> bytes:
    block = f"{version} 0 jobmix\n{ARC_FIELDS[version]}\n".encode()
    return b"filedesc://jobmix.arc 0.0.0.0 20200101000000 text/plain %d\n%s" % (
        len(block), block) if version == 1 else \
        b"filedesc://jobmix.arc 0.0.0.0 20200101000000 text/plain 200 - - 0 jobmix.arc %d\n%s" % (len(block), block)


def arc_record(version: int, page_id: int | None, url: str | None, html: str | None) -> bytes:
    payload = (html or "").encode()
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n" % len(payload)
            + (b"X-Page-Id: %d\r\n" % page_id if page_id is not None else b"") + b"\r\n")
    when = EPOCH + dt.timedelta(seconds=abs(page_id or 0) % 10**9)
    fields = {"URL": clean_url(url), "IP-address": "192.0.2.1", "Archive-date": f"{when:%Y%m%d%H%M%S}",
              "Content-type": "text/html", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0",
              "Filename": "jobmix.arc", "Archive-length": str(len(http) + len(payload))}
    line = " ".join(fields[name] for name in ARC_FIELDS[version].split(" "))
    return line.encode() + b"\n" + http + payload


def write_arc(pages: DataFrame, path: str, per_file: int = RECORDS_PER_FILE) -> str:
    """Write ``page_id, url, html`` as ARC files below ``path``; files take turns in their version."""
    def run(batches):
        def records():
            for n, row in enumerate(_rows(batches)):
                yield arc_record(1 + n // (per_file - 1) % 2, *row)
        yield from _batches(_with_heads(records(), lambda f: arc_head(1 + f % 2), per_file), LINE,
                            lambda r: len(r[0]))
    columns = pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url",
                               "cast(html as string) html")
    return _write(map_batches(columns, run, LINE), path, "\n", per_file)


def parse_arc(content: bytes) -> Iterator[dict]:
    """Records of an uncompressed ARC file: the URL line's fields by name, ``http`` and ``payload``.

    A URL with blanks in it (old crawlers wrote such) takes all fields that
    are too many.
    """
    at, names = 0, ARC_FIELDS[1].split(" ")
    while at < len(content):
        if content[at] in b"\r\n":
            at += 1
            continue
        end = content.index(b"\n", at)
        line = content[at:end].decode("utf-8", "replace").rstrip("\r")
        length = int(line.rsplit(" ", 1)[1])
        body = content[end + 1:end + 1 + length]
        if len(body) < length:
            raise ValueError(f"ARC record cut short: {line[:200]}")
        at = end + 1 + length
        if line.startswith("filedesc://"):
            names = body.decode().split("\n")[1].split(" ")
            continue
        fields = dict(zip(names, line.rsplit(" ", len(names) - 1)))
        cut = body.find(HTTP_END)
        has_head = body.startswith(b"HTTP/") and cut >= 0
        fields["http"] = body[:cut + 4] if has_head else b""
        fields["payload"] = body[cut + 4:] if has_head else body
        yield fields


def http_field(http: bytes, name: bytes) -> str | None:
    m = re.search(rb"(?mi)^" + re.escape(name) + rb":[ \t]*(.*?)\r?$", http)
    return m[1].decode() if m else None


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the ARC files below ``path``; without ``payloads`` only ids and digests."""
    schema = RECORD if payloads else INDEX

    def run(batches):
        def records():
            for (content,) in _rows(batches, 1):
                for r in parse_arc(gzip.decompress(content)):
                    page_id = http_field(r["http"], b"X-Page-Id")
                    found = (int(page_id) if page_id else None, digest(r["payload"]))
                    yield found + (r["URL"], r["IP-address"], r["Archive-date"], r["http"], r["payload"]) \
                        if payloads else found
        yield from _batches(records(), schema, (lambda r: len(r[6])) if payloads else (lambda r: 64))
    return map_batches(spark.read.format("binaryFile").load(path).select("content"), run, schema)


# ---------------------------------------------------------------------------
# WARC
# ---------------------------------------------------------------------------

def warc_record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends after it (the file writer adds those)."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def warc_head(_: int) -> bytes:
    block = b"software: jobmix\r\nformat: WARC File Format 1.1\r\n"
    return warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                        ("WARC-Date", f"{EPOCH:%Y-%m-%dT%H:%M:%SZ}"), ("Content-Type", "application/warc-fields")],
                       block)


def converted(page_id, payload_digest, url, ip, date, http, payload, holder) -> bytes:
    """The WARC record of an ARC record; a revisit where another page holds the payload."""
    revisit = holder is not None
    block = http if revisit else http + payload
    return warc_record([
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, payload_digest, url)),
        ("WARC-Date", f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"),
        ("WARC-Target-URI", url), ("WARC-IP-Address", ip),
        ("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None),
        ("WARC-Refers-To", record_id(holder, payload_digest, url) if revisit else None),
        ("X-Refers-To-Page-Id", holder),
        ("Content-Type", "application/http; msgtype=response")], block)


def revisits(index: DataFrame) -> DataFrame:
    """``page_id, payload_digest, holder`` of records whose payload a larger page id holds.

    Only ids and digests move.  The largest id of a digest is partially
    aggregated; joining it back is split where one digest has many rows.
    """
    holders = (index.where("page_id is not null").groupBy("payload_digest")
               .agg(F.max("page_id").alias("holder"), F.min("page_id").alias("least")).where("least < holder"))
    return (index.join(holders, "payload_digest").where("page_id < holder")
            .select("page_id", "payload_digest", "holder").distinct())


def to_warc(spark: SparkSession, arc_path: str, path: str, per_file: int = RECORDS_PER_FILE) -> str:
    """Convert the ARC files below ``arc_path`` to WARC files below ``path``.

    The payloads are shuffled once, by page id, to meet who holds theirs.
    """
    known = revisits(materialize(read_arc(spark, arc_path, payloads=False)))
    records = read_arc(spark, arc_path).join(known, ["page_id", "payload_digest"], "left")

    def run(batches):
        yield from _batches(_with_heads((converted(*r) for r in _rows(batches)), warc_head, per_file), LINE,
                            lambda r: len(r[0]))
    return _write(map_batches(records.select(*RECORD.names, "holder"), run, LINE), path, "\r\n\r\n", per_file)


def parse_warc(content: bytes) -> Iterator[tuple[dict, bytes]]:
    """Named fields and block of each record of an uncompressed WARC file."""
    at = 0
    while at < len(content):
        if content[at] in b"\r\n":
            at += 1
            continue
        end = content.index(HTTP_END, at)
        first, *lines = content[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:100]}")
        fields = dict(line.split(": ", 1) for line in lines)
        start = end + 4
        at = start + int(fields["Content-Length"])
        if at > len(content):
            raise ValueError(f"WARC record cut short: {fields.get('WARC-Record-ID')}")
        yield fields, content[start:at]


def read_back(fields: dict, block: bytes) -> tuple:
    cut = block.find(HTTP_END)
    http, payload = block[:cut + 4], block[cut + 4:]
    page_id = http_field(http, b"X-Page-Id")
    holder = fields.get("X-Refers-To-Page-Id")
    revisit = fields["WARC-Type"] == "revisit"
    size = int(http_field(http, b"Content-Length") or 0) if revisit else len(payload)
    found = fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else digest(payload)
    return (int(page_id) if page_id else None, size, found, fields["WARC-Type"], int(holder) if holder else None,
            fields.get("WARC-Target-URI"), fields.get("WARC-Date"), fields.get("WARC-Record-ID"),
            fields.get("WARC-Refers-To"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit record; a response's digest is worked out from its payload."""
    def run(batches):
        def records():
            for (content,) in _rows(batches, 1):
                for fields, block in parse_warc(gzip.decompress(content)):
                    if fields["WARC-Type"] in ("response", "revisit"):
                        yield read_back(fields, block)
        yield from _batches(records(), READ, lambda r: 256)
    return map_batches(spark.read.format("binaryFile").load(path).select("content"), run, READ)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc = write_arc(table(spark, sf_dir, "pages"), scratch_path(spark, "arc"))
    return read_warc(spark, to_warc(spark, arc, scratch_path(spark, "warc"))).select(*READ.names[:5])


OP2_SQL = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(hex, 1 + 10 * (i // 8)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31) + 1)::INT, 1)), '')
           AS payload_digest,
         max(page_id) OVER (PARTITION BY hex) AS holder
  FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id < holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < holder THEN holder END AS refers_to
FROM d
"""
