"""The kernel against its definition, held-out accuracy, and special cases."""

import itertools
import zlib

import numpy as np
import pytest

from loomwork.llm.toxicity import DECAY, FLOOR, SPAN, Landmarks, fit, logistic, score_documents


def plain_kernel(a, b):
    def phi(w):
        out = {}
        for k in itertools.combinations(range(len(w)), 3):
            if k[2] - k[0] < SPAN:
                f = w[k[0]] + w[k[1]] + w[k[2]]
                out[f] = out.get(f, 0) + DECAY ** (k[2] - k[0] + 1)
        return out

    x, y = phi(a), phi(b)
    dot = lambda p, q: sum(v * q.get(f, 0) for f, v in p.items())
    return dot(x, y) / max(np.sqrt(dot(x, x) * dot(y, y)), 1e-12)


def test_kernel():
    marks = ["stupid", "moron", "aaaa", "pathetic"]
    words = ["stupid", "st.upid", "sttupid", "cupid", "moron", "mo-ron", "baaab", "path", "x", "", "🙂🙂🙂", "qwxzvbkjhgfmnlqcwy" + "stupid" + "zxwvkqjhgbfnmlycw"]
    got = Landmarks(marks).matrix(words)
    for i, w in enumerate(words[:-1]):
        for j, m in enumerate(marks):
            want = plain_kernel(w, m)
            assert got[i, j] == pytest.approx(want if want >= FLOOR else 0, abs=1e-4)
    assert got[-1, 0] > FLOOR


def test_documents(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = fit(docs, labels)
    assert fit(docs, labels) == model
    rows = score_documents(docs, model).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [(r["score"], r["toxic"]) for r in rows if r["held_out"]]
    pos, neg = [s for s, t in held if t == 1], [s for s, t in held if t == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.88
    assert np.mean([(s >= 0.5) == (t == 1) for s, t in held]) > 0.92
    odd = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "you are a stupid idiot, a pathetic moron and a worthless loser", 5), (4, "🙂 " * 10, 5), (4, "🙂 " * 10, 5)], "doc_id long, text string, score int")
    got = [(r["doc_id"], r["score"]) for r in score_documents(odd, model).collect()]
    assert len(got) == 5 and max(got, key=lambda x: x[1])[0] is None and dict(got[:2])[1] == dict(got[:2])[2] < 0.5
    assert score_documents(odd.limit(0), model).collect() == []
    alone = fit(docs, labels.where("toxic = 0"))
    assert {r["score"] for r in score_documents(odd, alone).collect()} == {0.0}
    assert {r["score"] for r in score_documents(odd, fit(docs.limit(0), labels)).collect()} == {0.0}


def test_weights_stand_for_rows():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(200, 3))
    y = (x[:, 0] + rnd.normal(size=200) > 1).astype(float)
    times = np.where(y > 0, 1, 7)
    many = logistic(np.repeat(x, times, axis=0), np.repeat(y, times), np.ones(times.sum()))
    assert logistic(x, y, times) == pytest.approx(many, abs=1e-6)


def test_class_mix_does_not_follow_the_sample_size(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    known = docs.join(labels.select("doc_id", "toxic"), "doc_id").cache()
    truth = {r["doc_id"]: r["toxic"] for r in known.select("doc_id", "toxic").collect()}
    share = np.mean(list(truth.values()))
    found = {}
    for most in (300, 100_000):  # as many clean as toxic documents; all of them
        rows = score_documents(known, fit(docs, labels, most)).collect()
        found[most] = {r["doc_id"]: r["predicted"] for r in rows}
        assert abs(np.mean([r["score"] for r in rows]) - share) < 0.02
        assert abs(np.mean([r["predicted"] for r in rows]) - share) < 0.05
    assert np.mean([found[300][k] == found[100_000][k] for k in truth]) > 0.93
