"""License matches against containment of every template in every text."""

import re

from loomwork.llm.licenses import TEMPLATES, WIDTH, scan


def sets(text):
    w = re.sub("[^a-z0-9]+", " ", (text or "").lower()).strip().split(" ")
    return {tuple(w[k : k + WIDTH]) for k in range(len(w) - WIDTH + 1)}


def brute(rows):
    known = {k: sets(v) for k, v in TEMPLATES.items()}
    out = set()
    for d, text in rows:
        own = sets(text)
        out |= {(d, k, len(own & t), len(t)) for k, t in known.items() if 5 * len(own & t) >= 4 * len(t)}
    return out


def test_documents(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute(rows)
    assert want and {tuple(r) for r in scan(docs).collect()} == want


def test_special_cases(spark):
    filler = "lorem ipsum dolor sit amet consectetur " * 40
    rows = [(k, filler[: 37 * k] + " " + t.replace(" ", "\n ") + " " + filler) for k, t in enumerate(TEMPLATES.values())]
    notice = TEMPLATES["mit-permission"].split()
    notice[20] = "any"
    rows += [(100, " ".join(notice)), (101, None), (102, ""), (103, "MIT"), (104, filler * 20), (None, TEMPLATES["mit"]), (105, "LICENSED UNDER—CC BY NC 4 0"), (106, " ".join(TEMPLATES["mit-permission"].split()[:20]))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    want = brute(rows)
    assert {(d, k) for d, k, _, _ in want} >= {(k, name) for k, name in enumerate(TEMPLATES)} | {(100, "mit-permission"), (105, "cc-by-nc-4.0"), (None, "mit")}
    assert {tuple(r) for r in scan(df).collect()} == want
    assert scan(df.limit(0)).collect() == []
    assert scan(df, {}).collect() == []
