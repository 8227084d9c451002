"""Every stage of the pipeline against a plain version of its rule on the stage's own input."""

import pickle
import random

import corpus_pipeline as cp
from loomwork.llm.toxicity import ToxicityModel, fit
from tests.llm.test_near_dedup import brute as near_brute
from tests.llm.test_suffix_dedup import brute as suffix_brute


def test_stages(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet").cache()
    columns = docs.columns
    assert [k for k, _ in cp.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "suffix_dedup", "packing"]
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    before = texts(docs)
    model = pickle.loads(fit(docs, spark.read.parquet(f"{sf001}/labels.parquet")))
    out = cp.toxicity(spark, docs, sf001).cache()
    assert out.columns == columns
    assert texts(out) == {d: t for d, t in before.items() if model.scores([t or ""])[0] < 0.5}

    docs, before = out, texts(out)
    out = cp.exact(spark, docs, sf001).cache()
    last = {}
    for d, t in before.items():
        last[t or ""] = max(d, last.get(t or "", d))
    assert out.columns == columns and texts(out) == {d: before[d] for d in last.values()}

    docs, before = out, texts(out)
    out = cp.near(spark, docs, sf001).cache()
    assert out.columns == columns and texts(out) == {d: before[d] for d, x in near_brute(list(before.items()), 5).items() if x[2]}

    docs, before = out, texts(out)
    out = cp.repeats(spark, docs, sf001).cache()
    after = texts(out)
    assert out.columns == columns and set(after) == set(before)
    for d, x in suffix_brute(list(before.items()), 100).items():
        if x[1] == 0:
            assert after[d] == before[d]
        else:
            assert len((after[d] or "").encode()) <= x[0] - x[1]
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect() if r["text"] is not None)

    pieces = cp.packing(spark, out, sf001).collect()
    assert {r["doc_id"] for r in pieces} == set(after)


def test_null_and_repeated_ids(spark, sf001, monkeypatch):
    rnd = random.Random(3)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    frame = lambda rows: spark.createDataFrame([(d, t, s, len(t or "")) for d, t, s in rows], "doc_id long, text string, source string, n_chars long").repartition(5)
    rows_of = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)

    # toxic rows go, clean rows of the same id stay
    clean, toxic = [prose(30) for _ in range(80)], [prose(30) + " you stupid pathetic moron" for _ in range(80)]
    model = ToxicityModel(clean + toxic, [0] * 80 + [1] * 80)
    assert max(model.scores(clean)) < 0.5 <= min(model.scores(toxic))
    monkeypatch.setattr(cp, "fit", lambda docs, labels: pickle.dumps(model))
    odd = frame([(i, t, "s") for i in (None, 1) for t in toxic[:2] + clean[:2] + clean[:1]])
    assert rows_of(cp.toxicity(spark, odd, sf001)) == sorted([(i, t) for i in (None, 1) for t in clean[:2] + clean[:1]], key=str)

    # one row of each text, whatever the ids
    a, b, c = (prose(60) for _ in range(3))
    rows = [(5, a, "x"), (5, a, "y"), (5, b, "x"), (9, b, "x"), (None, a, "x"), (None, c, "x"), (None, c, "y"), (None, None, "x"), (None, "", "x")]
    got = rows_of(cp.exact(spark, frame(rows), sf001))
    assert sorted((t or "", str(d)) for d, t in got) == sorted([(a, "5"), (b, "9"), (c, "None"), ("", "None")])

    # near-duplicates link whatever their ids; one row of each component stays
    out = rows_of(cp.near(spark, frame([(None, a, "x"), (None, a + " more", "x"), (7, b, "x"), (7, b + " more", "x"), (7, c, "x")]), sf001))
    assert len(out) == 3 and sorted((t[:20], d) for d, t in out) == sorted([(a[:20], None), (b[:20], 7), (c[:20], 7)], key=lambda x: x[0])

    # every row stays once, with its own text; the first holds the passage
    rows = [(None, a, "x"), (None, "1 " + a, "y"), (None, b, "z"), (3, c, "x"), (3, c, "y"), (4, "short", "x")]
    out = cp.repeats(spark, frame(rows), sf001).collect()
    assert sorted((str(r["doc_id"]), r["source"]) for r in out) == sorted((str(d), s) for d, _, s in rows)
    left = sorted(len(r["text"]) for r in out)
    assert left[:3] in ([0, 0, 5], [0, 2, 5]) and left[3:] in ([len(a)] * 3, [len(a)] * 2 + [len(a) + 2])
    assert all(r["n_chars"] == len(r["text"]) for r in out)


def test_clashing_names_and_empty_tables(spark, sf001):
    rnd = random.Random(8)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    a, b = prose(60), prose(60)
    for ids in ((1, 2, 3, 4), (None, 2, 2, 4)):  # unique ids are keys themselves, others are dealt out
        rows = list(zip(ids, (a, a, a + " more", b), "wxyz", range(4), (7, 7, 8, 9), "stuv", [None] * 4))
        df = spark.createDataFrame(rows, "doc_id long, text string, _row string, _ROW_ int, rep int, _spans string, spans array<string>")
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, df, sf001)
            assert out.columns == df.columns
            got = [tuple(r) for r in out.collect()]
            assert {r[2:] for r in got} <= {r[2:] for r in rows}, name
            assert len(got) == {"toxicity": 4, "exact_dedup": 3, "near_dedup": 2, "suffix_dedup": 4}[name]
    none = df.limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, none, sf001).collect() == [], name
