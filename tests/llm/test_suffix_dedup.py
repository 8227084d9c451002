"""Repeated passages against a plain reading of the rule."""

import random
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from loomwork.llm.suffix_dedup import SuffixFamily, remove_repeats


def brute(rows, length):
    seen, out = {}, {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - length + 1):
            s = data[k : k + length]
            if s in seen:
                gone[k : k + length] = True
            seen[s] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out[doc_id] = (len(data), int(gone.sum()), int((edges == 1).sum()), sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def check(spark, rows, length, parts, **more):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(parts)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(df, length, **more).collect()}
    want = brute(rows, length)
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    rnd = random.Random(seed)
    passage = ["".join(rnd.choice("abé ") for _ in range(rnd.randint(20, 300))) for _ in range(6)]
    rows = []
    for k in range(120):
        text = "".join(rnd.choice(passage) if rnd.random() < 0.5 else "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(0, 200))) for _ in range(rnd.randint(0, 6)))
        rows.append((k * 7 % 120, text))
    rows += [(200, rows[5][1]), (201, rows[5][1]), (202, None), (203, ""), (None, rows[5][1]), (204, "x" * 700), (205, "ab" * 400), (206, "x" * 99)]
    check(spark, rows, 100, 5)
    check(spark, rows, 40, 3)


def test_hot_anchor(spark, monkeypatch):
    import loomwork.llm.suffix_dedup as sd

    rnd = random.Random(5)
    common = "".join(rnd.choice("abcdefgh ") for _ in range(160))
    rows = [(k, "".join(rnd.choice("abcdefgh ") for _ in range(60)) + common + "".join(rnd.choice("abcdefgh ") for _ in range(60))) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(20)
    spans = sd.repeated_spans(df, 100, hot=5).collect()
    want = brute(rows, 100)
    for r in spans:
        cut = sd.merged([x.asDict() for x in r["spans"]], 10**9)
        assert sum(b - a for a, b in cut) == want[r["doc_id"]][1]
    assert {r["doc_id"] for r in spans} == {k for k, w in want.items() if w[1]}


def test_long_text_and_blocks(spark, monkeypatch):
    rnd = random.Random(1)
    text = "".join(rnd.choice("abcdefghij ") for _ in range(1_200_000))
    rows = [(1, text), (2, "start " + text[500_000:] + text[:1000]), (3, text[1_048_000:1_049_000])]
    check(spark, rows, 100, 2)


def test_repeated_ids_and_empty(spark):
    df = spark.createDataFrame([(1, "q" * 50 + "r" * 60), (1, "q" * 50 + "r" * 60)], "doc_id long, text string")
    assert [r["n_removed"] for r in remove_repeats(df, 100).collect()] == [0, 0]
    assert remove_repeats(df.limit(0), 100).collect() == []


@pytest.mark.parametrize("length", [33, 40, 64, 100, 129])
def test_levels_are_few_and_in_the_order_of_bytes(length):
    family, rnd, held, seen, repeats, want = SuffixFamily(length), random.Random(length), {}, {}, set(), set()
    stock = [bytes(rnd.choice(b"ab\0\xff") for _ in range(200)) for _ in range(3)]
    for k in rnd.sample(range(64), 64):
        own = rnd.choice(stock)
        at = rnd.randint(0, 40)
        parts = [own[at : at + length + rnd.randint(0, 30)], bytes(rnd.choice(b"ab") for _ in range(length + rnd.randint(0, 20)))]
        data, places, start = b"".join(parts), [], []
        for j, part in enumerate(parts):
            for x in range(len(part) - length + 1):
                places.append(x + j * len(parts[0]))
                start.append(1000 * j + x)
                string = part[x : x + length]
                held[k, start[-1]] = string
                seen.setdefault(string, []).append((k, start[-1]))
        found = family.add(np.frombuffer(data, np.uint8), np.array(places), np.full(len(places), k), np.array(start))
        repeats |= {(int(d), int(x)) for ds, xs in found for d, x in zip(ds, xs)}
        strings = [[held[int(d), int(x)] for d, x in zip(level.doc, level.start)] for level in family.levels]
        assert all(x == sorted(set(x)) for x in strings)
        sizes = [len(x).bit_length() for x in family.levels]
        assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == len(sizes)
    for places in seen.values():
        want |= set(places) - {min(places)}
    assert repeats == want and len(want) > 100


def test_contents_are_told_apart_by_the_whole_hash(monkeypatch):
    import loomwork.llm.suffix_dedup as sd

    rnd = random.Random(6)
    common = "".join(rnd.choice("abcdefgh ") for _ in range(160))
    texts = ["".join(rnd.choice("abcdefgh ") for _ in range(60)) + common + "".join(rnd.choice("abcdefgh ") for _ in range(60)) for _ in range(40)]
    batches = [pa.RecordBatch.from_arrays([pa.array([k]), pa.array([t.encode()])], names=["doc_id", "text"]) for k, t in enumerate(texts)]

    def judged():
        sent = [b for own in batches for b in sd._cut([own], 100, 1)]  # each document from a partition of its own
        return sorted(tuple(r.items()) for b in sd._judge(sent, 100, 2000) for r in b.to_pylist())

    want, plain = judged(), sd.segments

    def high(*args):
        *rest, content = plain(*args)
        return *rest, content << np.uint64(40)  # hashes that differ above the lowest 40 bits only

    monkeypatch.setattr(sd, "segments", high)
    assert judged() == want
