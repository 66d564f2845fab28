"""WARC archives: a writer that stays in Spark SQL, and a salvage reader.

Writer: each record is one string expression and Spark's text sink writes it with CRLF as line end, so archives are
committed by Spark's own protocol to any store it can reach. Equal payloads from a minimum size on become revisits.

Reader: records are checked (version line, header block, length, closing CRLFs, block digest). After a failed check the
reader searches for the next version line, or the next gzip member, that starts a valid record, resumes there, and logs
the bytes between as a quarantined gap.

Defined results: null html is an empty payload; repeated rows are written and read each; a null page_id is written as
such and read as null; an empty table gives no records; control characters in URLs are percent-encoded.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bloom, tokens
from textloom.tables import materialize

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT_BYTES = 1000
#: Bytes of an archive file: readers hold one file at a time.
FILE_BYTES = 16 << 20
#: Longest gzip member, unpacked, that the reader accepts: it is held in memory, and a row of Spark's holds 2 GB at most.
MEMBER_BYTES = 1 << 30
FEED_BYTES = 64 << 10

READ_SCHEMA = "path string, offset bigint, kind string, record_type string, record_id string, target_uri string, refers_to_id string, payload_bytes bigint, payload_digest string, payload binary, gap_bytes bigint, reason string"


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    block: bytes
    end: int


@dataclass
class Gap:
    """Quarantined bytes [offset, end) and the check that failed at offset."""

    offset: int
    end: int
    reason: str


@dataclass
class Scan:
    records: list[Record] = field(default_factory=list)
    gaps: list[Gap] = field(default_factory=list)


_VERSION_LINE = re.compile(rb"WARC/[01]\.\d+\r\n")


def record_at(data: bytes, at: int) -> Record | str:
    """The record that starts at byte `at`, or why there is none."""
    version = _VERSION_LINE.match(data, at)
    if not version:
        return "no version line"
    stop = data.find(b"\r\n\r\n", version.end() - 2)
    # A header of any length, but not into the next record.
    if stop < 0 or _VERSION_LINE.search(data, version.end(), stop):
        return "header block does not end"
    headers = {}
    for line in data[version.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon and line:
            return "malformed header line"
        headers[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        return "no content length"
    start, end = stop + 4, stop + 4 + int(length)
    if end + 4 > len(data):
        return "record is truncated"
    if data[end : end + 4] != b"\r\n\r\n":
        return "record does not end with CRLF CRLF"
    block = data[start:end]
    algorithm, _, value = headers.get("warc-block-digest", "").partition(":")
    if algorithm == "sha1" and hashlib.sha1(block).hexdigest() != value:
        return "block digest differs"
    return Record(at, headers, block, end + 4)


def scan_plain(data: bytes, base: int = 0) -> Scan:
    """All valid records of uncompressed bytes, and the gaps between them."""
    out, at = Scan(), 0
    while at < len(data):
        found = record_at(data, at)
        if isinstance(found, Record):
            found.offset += base
            out.records.append(found)
            at = found.end
            continue
        # Every later version line is a candidate; the first that starts a valid record ends the gap.
        after = at + 1
        while line := _VERSION_LINE.search(data, after):
            if isinstance(record_at(data, line.start()), Record):
                break
            after = line.start() + 1
        end = line.start() if line else len(data)
        out.gaps.append(Gap(base + at, base + end, found))
        at = end
    return out


def member_at(data: bytes, at: int) -> tuple[bytes, int] | str:
    """The gzip member that starts at byte `at`, unpacked and checked, and where it ends."""
    unpack, parts, size, fed = zlib.decompressobj(31), [], 0, at
    try:
        while not unpack.eof and fed < len(data) and size <= MEMBER_BYTES:
            parts.append(unpack.decompress(data[fed : fed + FEED_BYTES]))
            size += len(parts[-1])
            fed += FEED_BYTES
    except zlib.error as why:
        return f"gzip: {why}"
    if not unpack.eof:
        return "gzip member is truncated or too long"
    return b"".join(parts), min(fed, len(data)) - len(unpack.unused_data)


def scan_gzip(data: bytes) -> Scan:
    """All valid records of a file with one gzip member for each record; offsets are of the members."""
    out, at = Scan(), 0
    while at < len(data):
        found = member_at(data, at)
        if not isinstance(found, str):
            inner = scan_plain(found[0])
            out.records += [Record(at, r.headers, r.block, found[1]) for r in inner.records]
            if inner.gaps:
                out.gaps.append(Gap(at, found[1], inner.gaps[0].reason))
            at = found[1]
            continue
        after = at + 1
        while (start := data.find(b"\x1f\x8b\x08", after)) >= 0:
            if not isinstance(member_at(data, start), str):
                break
            after = start + 1
        end = start if start >= 0 else len(data)
        out.gaps.append(Gap(at, end, found))
        at = end
    return out


def scan(data: bytes) -> Scan:
    return scan_gzip(data) if data[:2] == b"\x1f\x8b" else scan_plain(data)


def payload_of(record: Record) -> tuple[bytes | None, int, str]:
    """Payload, its full length and SHA-1: of a response from its bytes; of a revisit, which has none, from its headers."""
    head, _, body = record.block.partition(b"\r\n\r\n")
    if record.headers.get("warc-type") == "revisit":
        length = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        return None, int(length[1]) if length else -1, record.headers.get("warc-payload-digest", "").rpartition(":")[2]
    return body, len(body), hashlib.sha1(body).hexdigest()


def _read(keep_payload: bool):
    fields = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("kind", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("gap_bytes", pa.int64()), ("reason", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                name, found = path.as_py(), scan(content.as_py() or b"")
                rows = []
                for r in found.records:
                    payload, size, digest = payload_of(r)
                    h = r.headers
                    rows.append((name, r.offset, "record", h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), size, digest, payload if keep_payload else None, None, None))
                rows += [(name, g.offset, "gap", None, None, None, None, None, None, None, g.end - g.offset, g.reason) for g in found.gaps]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    return run


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """One row for each recovered record (kind "record") and each quarantined gap (kind "gap") of the archives under path."""
    tokens.bound_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter(F.col("length") > 0).select("path", "content").mapInArrow(_read(keep_payload), READ_SCHEMA)


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def records(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html -> `record`: the WARC record's text without its last CRLF."""
    spark = pages.sparkSession
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20\x7f]+", "%20").alias("url"), html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("n"))
    keyed = keyed.withColumn("key", F.xxhash64("digest", "n"))
    several = keyed.filter(F.col("n") >= min_revisit_bytes).groupBy("digest", "n", "key").agg(F.max("page_id").alias("response_id"), F.count("*").alias("copies")).filter("copies > 1")
    several = materialize(spark, several.select("digest", "n", "key", "response_id"), "warc-copies")
    # Only payloads that may have copies go through the join; all others are written where they are read.
    maybe = bloom.might_contain(spark.sparkContext.broadcast(bloom.build(several, "key")), "key")
    marked = keyed.withColumn("maybe", maybe)
    joined = marked.filter("maybe").join(several.drop("key"), ["digest", "n"], "left").unionByName(marked.filter("NOT maybe").withColumn("response_id", F.lit(None).cast("long")))
    revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    out = joined.select("page_id", "url", "digest", "response_id", revisit.alias("revisit"), block.alias("block"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1("block"))),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", _record_id(F.col("response_id"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    return out.select(F.concat(head, F.col("block"), F.lit("\r\n")).alias("record"))


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Write pages as uncompressed WARC files of about file_bytes each (a file holds whole records)."""
    sizes = pages.agg(F.avg(F.octet_length("html")).alias("mean"), F.max(F.octet_length("html")).alias("most")).head()
    per_file = int(min(file_bytes / ((sizes["mean"] or 0) + 600), (1 << 30) / ((sizes["most"] or 0) + 600)))
    records(pages, min_revisit_bytes).write.option("lineSep", "\r\n").option("maxRecordsPerFile", max(1, per_file)).text(path)


def op7_warc_salvage(pages: DataFrame, path: str) -> DataFrame:
    """Write pages as WARC archives under path, read them back, one row per page."""
    write_archives(pages, path)
    back = read_archives(pages.sparkSession, path, keep_payload=False).filter("kind = 'record'")
    number = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(-?\d*)>$", 1), F.lit("")).cast("long")
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to_id").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n, sha1(html) AS digest FROM p),
r AS (SELECT digest, n, max(page_id) AS response_id FROM h WHERE n >= 1000 GROUP BY digest, n)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN response_id IS NOT NULL AND page_id IS DISTINCT FROM response_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN response_id IS NOT NULL AND page_id IS DISTINCT FROM response_id THEN response_id END AS refers_to
FROM h LEFT JOIN r USING (digest, n)
"""
