"""Exact dedup against a dictionary of texts, with tables of every size down to none."""

import os
import random
import tempfile
from collections import Counter, defaultdict
from hashlib import sha256

import pytest

from loomwork.llm import exact_dedup as ed


def brute(rows):
    """(doc_id, keep_id, group_size, sha) of every row."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    low = lambda d: -(1 << 63) if d is None else d
    return Counter((d, max(groups[t or ""], key=low), len(groups[t or ""]), sha256((t or "").encode()).hexdigest()) for d, t in rows), groups


def check(rows, got):
    want, groups = brute(rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = Counter((r["doc_id"], r["text_sha256"]) for r in got if r["kept"])
    low = lambda d: -(1 << 63) if d is None else d
    assert kept == Counter((max(own, key=low), sha256(t.encode()).hexdigest()) for t, own in groups.items())


def cases():
    rnd = random.Random(5)
    rows = [(k, rnd.choice("abcdefghij") * rnd.randint(1, 40)) for k in range(400)]
    rows += [(k, "the hot text") for k in range(500, 700)]
    rows += [(7, "the hot text"), (699, "the hot text"), (699, "the hot text"), (None, "the hot text"), (None, None), (1, None), (2, ""), (None, "lonely"), (None, "lonely"), (3, "é" * 300_000), (4, "é" * 300_000)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("table_bytes", [0, 2000, ed.TABLE_BYTES])
def test_against_a_dictionary(spark, table_bytes):
    rows = cases()
    df = spark.createDataFrame([(d, t, "x", 1, b"y") for d, t in rows], "doc_id long, text string, content string, rep int, h binary").repartition(4)
    check(rows, ed.exact_dedup(df, table_bytes=table_bytes).collect())
    # whole rows: one of each text, as it was
    got = [(r["doc_id"], r["text"], r["content"], r["rep"], bytes(r["h"])) for r in ed.deduplicate(df, table_bytes=table_bytes).collect()]
    _, groups = brute(rows)
    low = lambda d: -(1 << 63) if d is None else d
    assert Counter((d, t or "") for d, t, *_ in got) == Counter((max(own, key=low), t) for t, own in groups.items())
    assert all(x[2:] == ("x", 1, b"y") for x in got) and all((d, t) in rows for d, t, *_ in got)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ed.exact_dedup(df).collect() == [] and ed.deduplicate(df).collect() == []
    assert ed.deduplicate(df).columns == ["doc_id", "text"]


@pytest.mark.parametrize("collect", [ed.listed, ed.largest])
def test_spilling_is_bounded_and_cleans_up(tmp_path, monkeypatch, collect):
    """With clashing hashes and a tiny table everything still meets its equals, through several levels of files."""
    monkeypatch.setattr(tempfile, "tempdir", str(tmp_path))
    deepest, made = [0], []
    plain = ed.grace

    def counted(records, table_bytes, depth=0, *more):
        deepest[0] = max(deepest[0], depth)
        return plain(records, table_bytes, depth, *more)

    monkeypatch.setattr(ed, "grace", counted)
    add = ed.ContentTable.add
    monkeypatch.setattr(ed.ContentTable, "add", lambda self, *a: (made.append(self.bytes), add(self, *a))[1])
    rnd = random.Random(1)
    rows = [(rnd.randint(0, 3), str(rnd.randint(0, 60)).encode() * 3) for _ in range(600)]
    records = [(h % 2, c, (k, 0, 0, c[:2])) for k, (h, c) in enumerate(rows)]
    records = [((len(c) << 60 | int(c[:1]) << 58) & 0xFFFFFFFFFFFFFFFF, c, m) for _, c, m in records]
    got = {c: sorted(m[0] for m in own) for _, c, own in ed.grace(iter(records), 1500, 0, collect)}
    want = defaultdict(list)
    for _, c, m in records:
        want[c].append(m[0])
    assert got == {c: [max(own)] if collect is ed.largest else own for c, own in want.items()}
    assert deepest[0] > 1 and max(made) <= 1500
    assert os.listdir(tmp_path) == []


def test_members_of_a_hot_text_count_as_bytes():
    """A group of copies fills its table, so that other contents go to files."""
    files = []
    records = [(1, b"hot", (k, 0, 0, b"")) for k in range(100)] + [(2, b"other", (0, 0, 0, b""))]
    read = ed._read
    ed._read = lambda path: (files.append(path), read(path))[1]
    try:
        out = {c: len(own) for _, c, own in ed.grace(iter(records), 5000)}
    finally:
        ed._read = read
    assert out == {b"hot": 100, b"other": 1} and len(files) == 1
