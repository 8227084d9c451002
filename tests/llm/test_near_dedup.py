"""Near-duplicate components against all pairs."""

import random
import re

import numpy as np
import pytest

from loomwork.llm.components import components
from loomwork.llm.near_dedup import NO_VALUE, SKETCH, bottom, estimate, estimates, near_classes


def word_sets(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} or {tuple(words)}


def brute(rows, width, num=4, den=5):
    sets = {d: word_sets(t, width) for d, t in rows if d is not None}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def check(spark, rows, width, parts=4, **more):
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, n long, rep string").repartition(parts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_classes(df, width, **more).collect() if r["doc_id"] is not None}
    want = brute(rows, width)
    assert got == want


def family(rnd, n, size, edits):
    base = [f"w{rnd.randint(0, 10**6)}" for _ in range(size)]
    for _ in range(n):
        words = list(base)
        for _ in range(rnd.randint(0, edits)):
            words[rnd.randrange(len(words))] = f"e{rnd.randint(0, 10**6)}"
        yield " ".join(words)


@pytest.mark.parametrize("width,small", [(4, 64), (5, 3)])
def test_families(spark, width, small):
    rnd = random.Random(width)
    texts = [t for _ in range(12) for t in family(rnd, rnd.choice([1, 2, 5, 30]), rnd.choice([6, 9, 40, 150]), 5)]
    texts += ["", " \n", "one", "ONE", "one two", "one two three four", "One two  three\tfour", "one two three four five", "café A b c d e", "CAFÉ a b c d e"]
    texts += texts[:7]
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    check(spark, [*zip(ids, texts), (10**6, None), (None, texts[0])], width, small=small)


def test_long_list_in_blocks(spark, monkeypatch):
    rnd = random.Random(3)
    texts = list(family(rnd, 160, 60, 6))
    check(spark, list(enumerate(texts)), 4, small=4)


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_classes(df, 4).collect()) == [(1, 1, True), (1, 1, True), (2, 1, False)]
    assert near_classes(df.limit(0), 4).collect() == []


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(10, 40)] + [(100, k) for k in range(101, 180)]
    for local in (0, 1000):
        got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), local=local).collect()}
        assert got == {**{k: 10 for k in range(10, 41)}, **{k: 100 for k in range(100, 180)}}


def test_documents(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_classes(docs, 4).collect()}
    assert got == brute(rows, 4)


def test_passages_and_a_large_family(spark):
    """At the registered bounds: lists longer than SMALL, of near copies, and of documents that share half their words only."""
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randint(0, 10**6)}"
    passage = [word() for _ in range(60)]
    halves = [[word() for _ in range(rnd.choice([20, 40, 60]))] for _ in range(110)]
    texts = [" ".join(passage + own) for own in halves]
    for k in range(0, 100, 4):  # near copies whose edits all lie outside the passage
        own = list(halves[k])
        own[rnd.randrange(len(own))] = word()
        texts.append(" ".join(passage + own))
    texts += family(rnd, 120, 90, 5)
    texts += [t + " end" for t in family(rnd, 90, 25, 4)]
    rnd.shuffle(texts)
    check(spark, list(enumerate(texts)), 4)


def test_estimates_of_many():
    rnd = np.random.default_rng(2)
    base = rnd.integers(0, 1 << 63, 300).astype(np.uint64)
    sketches = [bottom(rnd.choice(base, n, replace=False)) for n in (1, 5, 40, 64, 65, 200, 250, 300) for _ in range(4)]
    filled = np.full((len(sketches), SKETCH), NO_VALUE)
    for row, s in zip(filled, sketches):
        row[: len(s)] = s
    for s in sketches:
        assert estimates(s, filled).tolist() == [estimate(s, t) for t in sketches]
