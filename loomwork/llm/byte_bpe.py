"""Byte-level BPE through a sentencepiece model that is serialised here from the vocabulary.

Each entry of the rank file becomes a piece of byte-mapped characters (one printable character for
each byte) whose score is its negative rank, so sentencepiece merges the pair of lowest rank first,
the leftmost on a tie, as the rank file's own library does.  Normalisation is the identity and no
white space is added, dropped or escaped.  A text is cut into pre-tokens by the pattern; one that is an entry as a
whole takes its rank, as in the rank file's own library, and each other one is encoded by the model alone.
Ids are decoded by the inverse mapping of the model's pieces to bytes.

A null or empty text has no ids and decodes to nothing; a null doc_id is passed on; repeated rows
give repeated results; other columns don't matter.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import CHUNK, SPACE, ChunkCache, spans
from .common import batched, kept, rows_of, ship, spread


def byte_chars() -> list[str]:
    """A printable character for each byte: itself where it is one, else the next from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


CHARS = byte_chars()
BYTE_OF = {ord(c): b for b, c in enumerate(CHARS)}
#: For str.translate() on text decoded as Latin-1.
MAPPED = {b: c for b, c in enumerate(CHARS) if chr(b) != c}


def mapped(data: bytes) -> str:
    return data.decode("latin-1").translate(MAPPED)


def unmapped(piece: str) -> bytes:
    return bytes(map(BYTE_OF.__getitem__, map(ord, piece)))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | bytes | float) -> bytes:
    """A protobuf field: a varint, a length-delimited value or a 32-bit float."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


NORMAL, UNKNOWN, BPE = 1, 2, 2


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece ids are the ranks; one unknown piece follows them."""
    pieces = [(mapped(token), -float(rank), NORMAL) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    pieces.append(("<unk>", 0.0, UNKNOWN))
    body = b"".join(_field(1, _field(1, p.encode()) + _field(2, s) + _field(3, kind)) for p, s, kind in pieces)
    trainer = _field(3, BPE) + _field(4, len(pieces)) + _field(40, len(pieces) - 1) + b"".join(_field(k, (1 << 64) - 1) for k in (41, 42, 43))
    normalizer = _field(1, b"identity") + b"".join(_field(k, 0) for k in (3, 4, 5))
    return body + _field(2, trainer) + _field(3, normalizer)


class ByteBPE:
    """Encodes and decodes with the ranks at path and the pre-token pattern."""

    def __init__(self, path: str, pattern: str, cached: int = 96 << 20):
        import sentencepiece

        self.ranks = read_ranks(path)
        if sorted(self.ranks.values()) != list(range(len(self.ranks))):
            raise ValueError("ranks must be 0, 1, 2 and so on")
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.ranks))
        self.tokens = [unmapped(self.model.id_to_piece(k)) for k in range(len(self.ranks))]
        self.decimals = [str(k) for k in range(len(self.tokens))]
        self.pre = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE}\p{{L}}\p{{N}}]").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
        self.of_pre = ChunkCache(self._pre_tokens, cached)
        self.of_chunk = ChunkCache(self._chunks, cached)

    def _pre_tokens(self, pre_tokens: list[str]) -> list[bytes]:
        data = [p.encode() for p in pre_tokens]
        out = [None if (r := self.ranks.get(d)) is None else struct.pack("<I", r) for d in data]
        rest = [k for k, x in enumerate(out) if x is None]
        pieces = [mapped(data[k]) for k in rest]
        # a call with a list starts a thread pool, which only pays for long lists
        found = self.model.encode(pieces, num_threads=1) if len(pieces) > 200 else map(self.model.encode, pieces)
        for k, ids in zip(rest, found):
            out[k] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        parts = list(map(self.pre.findall, chunks))
        ids = iter(self.of_pre.get([p for x in parts for p in x]))
        return [b"".join(next(ids) for _ in x) for x in parts]

    def encode(self, text: str) -> np.ndarray:
        parts = (b"".join(self.of_chunk.get(CHUNK.findall(part))) for part in spans(text))
        return np.frombuffer(b"".join(parts), "<u4")

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def tokenizer(path: str, pattern: str) -> ByteBPE:
    """One for each worker process and vocabulary."""
    return kept((ByteBPE, path, pattern), lambda: ByteBPE(path, pattern))


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
FULL = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])


def _run(path: str, pattern: str, full: bool):
    def run(batches):
        bpe = tokenizer(path, pattern)

        def rows():
            for doc_id, text in rows_of(batches):
                ids = bpe.encode(text or "").tolist()
                decoded = bpe.decode(ids)
                if full:
                    yield doc_id, ids, decoded
                else:
                    decimal = " ".join(map(bpe.decimals.__getitem__, ids))
                    yield doc_id, len(ids), sha256(decimal.encode()).hexdigest(), sha256(decoded).hexdigest()

        yield from batched(rows(), FULL if full else DIGEST, (lambda r: 4 * len(r[1]) + len(r[2])) if full else None)

    return run


def encode_documents(docs: DataFrame, path: str, pattern: str, full: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """full: doc_id, ids, decoded (bytes); else the digest doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return spread(source).mapInArrow(_run(path, pattern, full), "doc_id long, ids array<int>, decoded binary" if full else "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
