"""Best-fit packing by exact-complement hashing.

Only counts by length decide what goes together, and there are at most ``capacity`` lengths, so the
plan is made on the driver from a table of bounded size, however many documents there are:

1. take the longest length left and its gap; where a single length, a pair or a triple of lengths
   that are still available sums to exactly the gap, consume that combination as often as the
   counts allow (one pattern with a multiplicity);
2. where none does, put in the longest length that fits (best fit) and look again.

Every pattern with its multiplicity exhausts a length, so there are O(capacity) patterns.  A piece
finds its place from its rank among the pieces of its length; ranks come from counts by input
partition and length, so no length, however common, meets in one task.

A null text counts as empty, which leaves the closing id alone (a piece of one token).  Repeated or
null doc_ids are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import mapped
from .chunks import WORD, ChunkCache, spans
from .common import batched, kept, materialize, rows_of, ship, spread


# ---------------------------------------------------------------- tokens


class WordTokenizer:
    """ids of the tokenizers library's word BPE, by a cache of white-space separated words.

    Its normaliser and pattern never look across white space, so a word's ids don't depend on its
    neighbours.  Words of characters below U+0300, which NFC leaves alone, are lower-cased and split
    here and go to the library's BPE model; all others go through the whole library.
    """

    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    PLAIN = regex.compile(r"[!-˿]+")
    ODD_SPACE = tuple("\x1c\x1d\x1e\x1f")

    def __init__(self, path: str, cached: int = 192 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.of_part = ChunkCache(self._parts, cached)
        self.of_word = ChunkCache(self._words, cached)

    def _parts(self, parts: list[str]) -> list[bytes]:
        tokenize = self.model.tokenize
        out = []
        for p in parts:
            ids = [t.id for t in tokenize(p if p.isascii() and "\x7f" not in p else mapped(p.encode()))]
            out.append(struct.pack(f"<{len(ids)}I", *ids))
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(words)
        plain = [k for k, w in enumerate(words) if self.PLAIN.fullmatch(w) and "<|" not in w and "\x85" not in w and "\xa0" not in w]
        parts = [self.SPLIT.findall(words[k].lower()) for k in plain]
        ids = iter(self.of_part.get([p for x in parts for p in x]))
        for k, x in zip(plain, parts):
            out[k] = b"".join(next(ids) for _ in x)
        rest = [k for k, x in enumerate(out) if x is None]
        for at in range(0, len(rest), 1024):
            some = rest[at : at + 1024]
            for k, e in zip(some, self.whole.encode_batch_fast([words[k] for k in some], add_special_tokens=False)):
                out[k] = np.array(e.ids, "<u4").tobytes()
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if any(c in text for c in self.ODD_SPACE):
            cut = WORD.findall
        else:
            cut = str.split
        return b"".join(b"".join(self.of_word.get(cut(part))) for part in spans(text))


def word_tokenizer(path: str) -> WordTokenizer:
    """One for each worker process and vocabulary."""
    return kept((WordTokenizer, path), lambda: WordTokenizer(path))


PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])
PIECE_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
CLOSING = struct.pack("<I", 1)


def _pieces(path: str, capacity: int):
    def run(batches):
        tokens, part, seen = word_tokenizer(path), TaskContext.get().partitionId(), defaultdict(int)

        def rows():
            for doc_id, text in rows_of(batches):
                ids = tokens.encode(text or "") + CLOSING
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    length = len(own) // 4
                    yield doc_id, piece, at // 4, length, zlib.crc32(own), part, seen[length]
                    seen[length] += 1

        yield from batched(rows(), PIECE)

    return run


# ---------------------------------------------------------------- plan


class Availability:
    """Counts of lengths, and the combinations of up to three that sum to a given gap."""

    def __init__(self, counts: np.ndarray):
        self.n = counts.astype(np.int64).copy()

    def best_fit(self, gap: int) -> int:
        """The longest available length up to gap; 0 if there is none."""
        k = np.flatnonzero(self.n[1 : gap + 1])
        return int(k[-1]) + 1 if len(k) else 0

    def pair(self, gap: int, most: int | None = None) -> tuple[int, int] | None:
        """(a, b) with a >= b and a + b = gap; the longest a (up to most) first, which spares short lengths."""
        half = (gap + 1) // 2
        top = gap - 1 if most is None else min(most, gap - 1)
        if top < half:
            return None
        a = np.arange(top, half - 1, -1)
        ok = (self.n[a] > 0) & (self.n[gap - a] > 0)
        if gap % 2 == 0 and self.n[gap // 2] < 2:
            ok &= a != gap // 2
        k = int(ok.argmax()) if len(ok) else 0
        return (int(a[k]), gap - int(a[k])) if len(ok) and ok[k] else None

    def exact(self, gap: int) -> list[int] | None:
        if self.n[gap]:
            return [gap]
        if p := self.pair(gap):
            return list(p)
        for a in np.flatnonzero(self.n[1 : max(gap - 1, 1)])[::-1] + 1:
            a = int(a)
            self.n[a] -= 1
            p = self.pair(gap - a, a)
            self.n[a] += 1
            if p:
                return [a, *p]
            if 3 * a < gap:
                break
        return None


def plan(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """(multiplicity, lengths of one sequence) for counts[length], until every count is used."""
    left, out = Availability(counts), []
    while longest := left.best_fit(capacity):
        made, gap = [longest], capacity - longest
        left.n[longest] -= 1
        while gap:
            more = left.exact(gap) or ([b] if (b := left.best_fit(gap)) else [])
            if not more:
                break
            for x in more:
                left.n[x] -= 1
            made += more
            gap -= sum(more)
        own = np.bincount(made, minlength=len(left.n))
        used = np.flatnonzero(own)
        times = 1 + int((left.n[used] // own[used]).min())
        left.n[used] -= (times - 1) * own[used]
        out.append((times, made))
    return out


def slots(plans: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence and offset of each run of places, ranks rising."""
    runs, used, sequence = defaultdict(list), defaultdict(int), 0
    for times, made in plans:
        at = 0
        for x in made:
            runs[x].append((used[x], sequence, at))
            used[x] += times
            at += x
        sequence += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*r)) for x, r in runs.items()}


PLACED_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
PLACED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _place(places: dict):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (3, 5))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(own):
                    first, number, at = places[int(length[own[0]])]
                    k = np.searchsorted(first, rank[own], "right") - 1
                    sequence[own], offset[own] = number[k] + rank[own] - first[k], at[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], schema=PLACED)

    return run


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = materialize(spread(source).mapInArrow(_pieces(path, capacity), PIECE_SQL), "pieces")
    by_part = pieces.groupBy("length", "part").count()
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_part.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most capacity rows
        counts[r["length"]] = r["n"]
    before = by_part.withColumn("base", F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = pieces.join(before.select("length", "part", F.coalesce("base", F.lit(0)).alias("base")), ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank")
    )
    return ranked.mapInArrow(_place(slots(plan(counts, capacity))), PLACED_SQL)
