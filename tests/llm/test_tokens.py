"""Byte-level BPE and packing against the tokenizer libraries themselves."""

import base64
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomwork.llm.byte_bpe import ByteBPE, encode_documents
from loomwork.llm.chunks import ChunkCache
from loomwork.llm.packing import WordTokenizer, pack_documents, plan, slots

ODD = ["", "\x7f", "a\x7fb", " ", "\n\n a\t b  \r\n", "it's we'll I'M 12345 ½ ٣", "naïve façadé é ΑΣ İstanbul ǅ", "日本語テキスト 漢字", "🙂👩‍👩‍👧 ​ x　y\x85z\xa0w", "\x1c\x1da\x1f b\x00c", "<|endoftext|> a<|startoftext|>b", "a" * 5000, "ab" * 3000 + " " * 500 + "é" * 900, "x.y,z;" * 400, "́ ́a"]


@pytest.fixture(scope="module")
def bpe():
    return ByteBPE(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def own():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def words():
    return WordTokenizer(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))


@pytest.mark.parametrize("text", ODD)
def test_byte_bpe_odd_texts(bpe, own, text):
    ids = bpe.encode(text).tolist()
    assert ids == own.encode_ordinary(text)
    assert bpe.decode(ids) == text.encode()


def test_pieces_map_back_to_every_entry(bpe, own):
    assert bpe.tokens == [own.decode_single_token_bytes(k) for k in range(len(bpe.ranks))]


def test_caches_are_bounded_by_bytes():
    made = []
    cache = ChunkCache(lambda some: (made.extend(some), [c.encode() * 2 for c in some])[1], limit=5000)
    for k in range(200):
        words = [f"w{k}", f"v{k}", "often"]
        assert cache.get(words) == [w.encode() * 2 for w in words]
        assert 2 * cache.bytes <= 5000 and len(cache.young) + len(cache.old) < 30
    assert made.count("often") == 1 and made.count("w0") == 1
    assert cache.get(["w0"]) == [b"w0w0"] and made.count("w0") == 2


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_byte_bpe_any_text(bpe, own, text):
    assert bpe.encode(text).tolist() == own.encode_ordinary(text)


@pytest.mark.parametrize("text", ODD)
def test_word_tokens_odd_texts(words, text):
    assert np.frombuffer(words[0].encode(text), "<u4").tolist() == words[1].encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_word_tokens_any_text(words, text):
    assert np.frombuffer(words[0].encode(text), "<u4").tolist() == words[1].encode(text, add_special_tokens=False).ids


def test_documents(spark, sf001, own, words):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect():
        ids = own.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == sha256(texts[r["doc_id"]].encode()).hexdigest()
    check_packing(pack_documents(docs, P.path("word_bpe_49k.json")).collect(), texts, words[1], 4096)


def check_packing(rows, texts, tokenizer, capacity):
    pieces, places = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for doc_id, own in pieces.items():
        ids = [*tokenizer.encode(texts[doc_id], add_special_tokens=False).ids, 1]
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // capacity)
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == r["piece"] * capacity and len(part) == r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in rows)
    assert len(places) <= max(-(-total // capacity) * 1.05, -(-total // capacity) + 1, sum(r["length"] > capacity // 2 for r in rows) + 1)


def test_packing_special_cases(spark, words):
    rows = [(1, None, 5), (2, "", 5), (3, "a b c", 5), (4, "a b c", 5), (5, "tok " * 50, 5), (None, "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = pack_documents(df, P.path("word_bpe_49k.json"), capacity=16).collect()
    assert sum(r["doc_id"] is None for r in got) == 1
    assert sorted((r["piece"], r["length"]) for r in got if r["doc_id"] == 5) == [(0, 16), (1, 16), (2, 16), (3, 3)]
    assert {r["length"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert pack_documents(df.limit(0), P.path("word_bpe_49k.json")).collect() == []
    assert encode_documents(df.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plan_uses_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=65)
    made = plan(counts, 64)
    used = np.zeros(65, int)
    for times, own in made:
        assert sum(own) <= 64
        np.add.at(used, own, times)
    assert (used == counts).all()
    best = -(-sum(lengths) // 64)
    assert sum(t for t, _ in made) <= max(1.25 * best + 2, sum(x > 32 for x in lengths) + 1)
    for x, (first, sequence, at) in slots(made).items():
        assert first[0] == 0 and (np.diff(first) > 0).all()
