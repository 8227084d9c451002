"""Counts under edits against encoding the whole text anew."""

import base64
import random

import public_tokenizers as P
import pytest
import tiktoken

from loomwork.llm.byte_bpe import ByteBPE
from loomwork.llm.edit_counts import CountTree, applied, edited_counts, sample_edits


@pytest.fixture(scope="module")
def own():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("seed", range(6))
def test_edits(own, seed):
    bpe, rnd = ByteBPE(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), random.Random(seed)
    bits = [" ", "  ", "\n", "word", "é", "12", "'s", "!?", "　", "inter", "\x1c"]
    make = lambda n: "".join(rnd.choice(bits) for _ in range(n))
    text = make(rnd.choice([0, 1, 40, 3000]))
    tree = CountTree(text, bpe)
    for k in range(120):
        at = rnd.randint(-2, len(text) + 2)
        e = (at, at + rnd.choice([0, 0, 1, 3, 200]), make(rnd.choice([0, 1, 2, 30, 900 if k % 40 == 0 else 3])))
        text = applied(text, [e])
        tree.edit(*e)
        assert tree.text() == text and tree.length == len(text)
        assert tree.total == len(own.encode_ordinary(text))


def test_only_touched_regions_are_encoded():
    bpe = ByteBPE(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    tree = CountTree("some words here " * 20_000, bpe)
    for k in range(50):
        tree.edit(k * 5000, k * 5000 + 2, "x")
    assert tree.encoded < 50 * 1000


def test_documents(spark, sf001, own):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = edited_counts(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]]
        after = applied(t, sample_edits(r["doc_id"], len(t)))
        assert (r["n_chars"], r["n_tokens"]) == (len(t), len(own.encode_ordinary(t)))
        assert (r["n_chars_after"], r["n_tokens_after"]) == (len(after), len(own.encode_ordinary(after)))
    odd = spark.createDataFrame([(1, None, None, 0), (None, "a b", [(0, 1, "xyz"), (9, 9, None)], 0), (2, "", [(0, 5, "new")], 0)], "doc_id long, text string, e array<struct<start:int,end:int,text:string>>, n_tokens int")
    got = {r["doc_id"]: (r["n_tokens"], r["n_tokens_after"]) for r in edited_counts(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, "e").collect()}
    assert got == {1: (0, 0), None: (2, len(own.encode_ordinary("xyz b"))), 2: (0, 1)}
    assert edited_counts(odd.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect() == []
