"""WARC archives: a writer with revisit records, and a splittable reader.

Writing: each record is a gzip member of its own.  Of records with equal payloads the one of the
smallest id is a response, the others are revisits of it, which keep the HTTP headers and drop the
payload.  Every attempt of a task writes a file of its own; the manifest names the files of the
attempts that counted, so lost executors leave at most files that nobody reads.

Reading: archives are cut into byte ranges, one row each, and dealt to tasks.  A task scans its range
for the gzip magic, validates a candidate by decoding its first bytes to a WARC header and the
member to its end (with its checksum), and owns the records that start inside the range, reading
past its end where the last one needs it.  A magic that occurs within compressed data fails the
validation and is passed over.

Results for special cases: a null payload is empty; a null URL is an empty one; line ends and
spaces in a URL are percent-encoded; rows that repeat the smallest id of their payload are responses;
null ids are read back as null (and revisit the smallest id, if their payload has one); an empty
table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, materialize, release, rows_of, scratch_path, ship, spread

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a range that one reader row covers, and of one read.
RANGE_BYTES, READ_BYTES = 8 << 20, 1 << 18
TASK_RANGES = 32
DATE = "2000-01-01T00:00:00Z"


# ---------------------------------------------------------------- writing


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(sha1(data).digest()).decode()


def record(kind: str, record_id: str, block: bytes, date: str = DATE, **more: str) -> bytes:
    """A record as one gzip member; more: further headers, with _ for -."""
    head = [f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{record_id}>\r\nWARC-Date: {date}"]
    head += [f"{k.replace('_', '-')}: {v}" for k, v in more.items()]
    head.append(f"Content-Length: {len(block)}\r\n\r\n")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    headers = {"WARC_Target_URI": target, "WARC_Payload_Digest": f"sha1:{base32_sha1(payload)}", "Content_Type": "application/http;msgtype=response"}
    name = f"urn:page:{'' if page_id is None else page_id}"
    if refers_to is None:
        return record("response", name, http + payload, **headers)
    return record("revisit", name, http, WARC_Profile=PROFILE, WARC_Refers_To=f"<urn:page:{refers_to}>", **headers)


def _write(folder: str):
    def run(batches):
        release()
        store, base = fs.FileSystem.from_uri(folder)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, size, count = None, 0, 0
        for page_id, url, payload, refers_to in rows_of(batches):
            if out is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(f"{base}/{name}", compression=None)
                size += out.write(record("warcinfo", f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}", b"format: WARC File Format 1.1\r\n", Content_Type="application/warc-fields"))
            size += out.write(page_record(page_id, url, payload, refers_to))
            count += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size]), pa.array([count])], names=["path", "bytes", "records"])

    return run


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes the rows to archives in folder (one on shared storage by default) and returns the manifest: path, bytes, records.

    Payloads of fewer than least_bytes bytes are responses always.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = folder or scratch_path(spark, "warc")
    source = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload")
    ).withColumn("key", F.sha2("payload", 256))
    first = source.where(F.length("payload") >= least_bytes).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    joined = spread(source).join(materialize(first, "payloads"), "key", "left")
    joined = joined.select("page_id", "url", "payload", F.expr("case when not (page_id <=> first) then first end").alias("refers_to"))
    return materialize(joined.mapInArrow(_write(folder), "path string, bytes long, records long"), "manifest")


# ---------------------------------------------------------------- reading


class Window:
    """Bytes of a file by offset, through a buffer."""

    def __init__(self, path: str):
        store, where = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(where)
        self.size = self.file.size()
        self.at, self.buffer = 0, b""

    def read(self, offset: int, n: int) -> bytes:
        if not (self.at <= offset and offset + n <= self.at + len(self.buffer)):
            self.at, self.buffer = offset, self.file.read_at(max(n, READ_BYTES), offset)
        return self.buffer[offset - self.at : offset - self.at + n]

    def close(self) -> None:
        self.file.close()


def member(window: Window, offset: int) -> tuple[bytes, int] | None:
    """The record of the gzip member that starts at offset, and the offset behind it; None if no WARC record starts there."""
    z, out, at, checked = zlib.decompressobj(31), [], offset, b""
    try:
        while not z.eof:
            data = window.read(at, 1 << 14)
            if not data:
                return None
            at += len(data)
            out.append(z.decompress(data))
            if checked is not None:
                checked += out[-1]
                if not b"WARC/".startswith(checked[:5]):
                    return None
                if len(checked) >= 5:
                    checked = None
    except zlib.error:
        return None
    if checked is not None:
        return None
    return b"".join(out), at - len(z.unused_data)


def records_in(path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of the records whose member starts in [start, end)."""
    window, at = Window(path), start
    try:
        while at < end:
            data = window.read(at, min(READ_BYTES // 2, end - at + len(MAGIC) - 1))
            k = data.find(MAGIC)
            if k < 0:
                at += max(len(data) - len(MAGIC) + 1, 1)
                continue
            at += k
            if at >= end:
                break
            found = member(window, at)
            if found is None:
                at += 1
            else:
                yield at, found[0]
                at = found[1]
    finally:
        window.close()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    return headers, rest[: int(headers.get("content-length", len(rest)))]


RECORD = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("http_length", pa.int64()), ("payload", pa.binary())])
RECORD_SQL = "path string, offset long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, http_length long, payload binary"


def _read(batches):
    release()

    def rows():
        for path, start, end in rows_of(batches):
            for offset, data in records_in(path, start, end):
                headers, block = parse(data)
                payload, length = block, None
                if headers.get("content-type", "").startswith("application/http"):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    m = re.search(rb"(?im)^content-length:\s*(\d+)", http)
                    length = int(m[1]) if m else None
                digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
                plain = [None if (v := headers.get(k)) is None else v.strip("<>") for k in ("warc-record-id", "warc-target-uri", "warc-refers-to")]
                yield path, offset, headers.get("warc-type"), *plain, digest, length, payload

    yield from batched(rows(), RECORD, lambda r: len(r[8]))


def read_archives(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records of the archives in a table of path and bytes (such as a manifest).

    The number of tasks is that of the ranges, or for very many of them of TASK_RANGES ranges each.
    """
    spark = archives.sparkSession
    ship(spark)
    ranges = archives.agg(F.sum(F.expr(f"greatest(bytes, 1L) div {range_bytes} + 1"))).first()[0] or 1
    tasks = max(min(ranges, 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))), ranges // TASK_RANGES)
    ranges = archives.select("path", "bytes", F.explode(F.expr(f"sequence(0L, greatest(bytes, 1L) - 1, {range_bytes}L)")).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + range_bytes, "bytes").alias("end")).repartition(tasks)
    return ranges.mapInArrow(_read, RECORD_SQL)


def _digest(batches):
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def number(urn: str | None) -> int | None:
        text = (urn or "").removeprefix("urn:page:")
        return int(text) if text else None

    def rows():
        for kind, name, refers_to, digest, length, payload in rows_of(batches):
            if kind == "response":
                yield number(name), len(payload), base32_sha1(payload), kind, None
            else:
                yield number(name), length, digest, kind, number(refers_to)

    yield from batched(rows(), schema)


def page_digests(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records that write_archives() wrote."""
    own = records.where("record_type in ('response', 'revisit')").select("record_type", "record_id", "refers_to", "payload_digest", "http_length", "payload")
    return own.mapInArrow(_digest, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
