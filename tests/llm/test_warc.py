"""Archives: round trip, ranges of any size, stray magics, special cases."""

import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from loomwork.llm.warc import MAGIC, page_digests, parse, read_archives, record, records_in, write_archives


def want(rows):
    first = {}
    for page_id, _, html in rows:
        if page_id is not None:
            first[html or ""] = min(page_id, first.get(html or "", page_id))
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        f = first.get(html or "")
        revisit = f is not None and f != page_id
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_round_trip(spark, sf001):
    pages = spark.read.parquet(f"{sf001}/pages.parquet")
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    assert got(page_digests(read_archives(write_archives(pages)))) == want(rows)


def test_special_cases(spark):
    rows = [(3, "http://a b\r\nX: y", "<p>é</p>"), (1, None, "<p>é</p>"), (None, "u", "<p>é</p>"), (4, "u", None), (5, "u", ""), (6, "u", "x" * 3_000_000), (7, "u", "a\r\n\r\nb"), (1, "again", "<p>é</p>")]
    df = spark.createDataFrame([(*r, "more") for r in rows], "page_id long, url string, html string, path string").repartition(3)
    manifest = write_archives(df)
    for size in (300, 5000, 1 << 20):
        records = read_archives(manifest, size)
        assert got(page_digests(records)) == want(rows)
        assert size > 5000 or records.select(F.spark_partition_id()).distinct().count() > 1
    assert {r["payload"] for r in records.where("record_id = 'urn:page:7'").collect()} == {b"a\r\n\r\nb"}
    assert got(page_digests(read_archives(write_archives(df.limit(0))))) == []
    alone = page_digests(read_archives(write_archives(df, least_bytes=100))).collect()
    assert {r["record_type"] for r in alone} == {"response"}


def test_every_range_owns_its_records(tmp_path):
    blocks = [MAGIC * k + bytes(range(256)) * (k % 3) for k in range(12)]
    members = [record("resource", f"urn:page:{k}", b) for k, b in enumerate(blocks)]
    # members that are stored, not compressed, so that the magics inside show
    members[5] = gzip.compress(b"WARC/1.1\r\nWARC-Record-ID: <urn:page:5>\r\nContent-Length: 9\r\n\r\n" + MAGIC * 3 + b"\r\n\r\n", 0)
    members.insert(3, gzip.compress(b"no record"))
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"junk\x1f\x8b" + b"".join(members) + MAGIC)
    size = path.stat().st_size
    starts = [at for at, _ in records_in(str(path), 0, size)]
    assert len(starts) == 12
    for step in (1, 7, 50, 333):
        found = [(at, data) for a in range(0, size, step) for at, data in records_in(str(path), a, min(a + step, size))]
        assert [at for at, _ in found] == starts
        assert [parse(d)[0]["warc-record-id"] for _, d in found] == [f"<urn:page:{k}>" for k in range(12)]
