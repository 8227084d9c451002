"""The curve's steps, and the neighbours against brute force."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from loomwork.llm.hilbert import hilbert_keys, nearest


def test_curve_visits_all_cells_by_single_steps():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims)).reshape(dims, -1).T
        keys = hilbert_keys(cells, bits)
        order = np.argsort(keys)
        assert (keys[order] == np.arange(len(keys))).all()
        assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def brute(ids, v, every, k):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = (v @ v[q]) / (np.linalg.norm(v, axis=1) * np.linalg.norm(v[q]))
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[j]), float(s[j])) for j in order]
    assert np.isfinite(u).all()
    return out


def rows_by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    assert set(got) == set(want)
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / (5 * len(want))


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = df.toPandas()
    ids, v = pdf["vec_id"].to_numpy(), np.stack(pdf["embedding"]).astype(float)
    assert recall(rows_by_query(nearest(df, "vec_id % 50 = 0", 5)), brute(ids, v, 50, 5)) >= 0.98


def test_recall_of_vectors_without_structure(spark, tmp_path):
    """The registered settings on 20 blocks a curve, in the worst case; and with small windows, which must be narrower than the table."""
    v = np.random.default_rng(4).standard_normal((20_000, 64)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(len(v)), "embedding": list(v)}), tmp_path / "v.parquet")
    df, want = spark.read.parquet(str(tmp_path)), brute(np.arange(len(v)), v.astype(float), 500, 5)
    got = rows_by_query(nearest(df, "vec_id % 500 = 0", 5))
    assert recall(got, want) >= 0.93
    assert all(abs(dict(want[q])[i] - s) < 1e-9 for q, r in got.items() for i, s in r if i in dict(want[q]))
    assert 0.02 < recall(rows_by_query(nearest(df, "vec_id % 500 = 0", 5, curves=4, reach=16, rows=40)), want) < 0.5


def test_windows_are_whole_across_blocks_and_partitions(spark):
    """Along a line of one dimension the window decides alone what is found."""
    angle = np.linspace(0.1, 3.0, 400)
    rows = [(k, [float(np.cos(a)), float(np.sin(a))]) for k, a in enumerate(angle)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    got = rows_by_query(nearest(df, "true", 4, curves=3, rows=10, reach=25))
    assert len(got) == 400
    for q, r in got.items():
        want = set(np.argsort(np.abs(angle - angle[q]), kind="stable")[1:5].tolist())
        assert len({i for i, _ in r} & want) >= 3


def test_special_cases(spark):
    rnd = np.random.default_rng(0)
    rows = [(k, rnd.standard_normal(4).tolist(), 1) for k in range(40)]
    rows += [(100 + k, rows[0][1], 1) for k in range(12)] + [(0, rows[0][1], 1)]
    good = list(rows)
    rows += [(200, None, 1), (250, [0.0] * 4, 1), (300, [1.0, None, 2.0, 1.0], 1), (350, [1.0, float("nan"), 0.0, 0.0], 1), (400, [float("inf"), 0.0, 0.0, 1.0], 1), (None, [1.0, 2.0, 3.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = rows_by_query(nearest(df, "vec_id % 50 = 0", 5))
    one = {i: v for i, v, _ in good}
    ids = np.array(sorted(one))
    want = brute(ids, np.array([one[i] for i in ids]), 50, 5)
    assert {q: [i for i, _ in r] for q, r in got.items()} == {q: [i for i, _ in r] for q, r in want.items()}
    assert all(abs(a - b) < 1e-12 for q in want for (_, a), (_, b) in zip(got[q], want[q]))
    few = spark.createDataFrame(rows[:3], df.schema)
    assert {q: len(r) for q, r in rows_by_query(nearest(few, "vec_id = 1", 5)).items()} == {1: 2}
    assert nearest(df.limit(0), "vec_id % 50 = 0", 5).collect() == []
