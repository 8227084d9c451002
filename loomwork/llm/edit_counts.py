"""Edit-aware token counts.

A document is kept as a segment tree whose leaves hold some LEAF chunks each (white space and what
follows it; pre-tokens never cross the start of a chunk) and whose nodes hold the sums of characters
and tokens below them.  An edit finds its leaves by descending on the character sums.  Only the
text of the leaves that it touches is encoded again, with neighbours where the edit has moved a chunk's
start (the boundary context); the sums on the paths to the root follow.  A leaf that grows too
long is cut and the tree built anew from the leaves' sums, without encoding the rest.

A null text counts as empty; edits are clipped to the text; an empty table gives no rows; repeated
rows and null ids are rows of their own; further columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import ByteBPE, tokenizer
from .chunks import CHUNK, SPACE, spans
from .common import batched, rows_of, ship, spread

LEAF = 32
#: Characters of a leaf above which it is cut.
LONG = 4096
SPACES = frozenset(re.findall(f"[{SPACE}]", "".join(map(chr, range(0x3001)))))


class CountTree:
    """Token counts of one text under edits."""

    def __init__(self, text: str, bpe: ByteBPE):
        self.bpe, self.encoded = bpe, 0
        texts, counts = [], []
        for part in spans(text):
            chunks = CHUNK.findall(part)
            sizes = [len(x) // 4 for x in bpe.of_chunk.get(chunks)]
            for k in range(0, len(chunks), LEAF):
                texts.append("".join(chunks[k : k + LEAF]))
                counts.append(sum(sizes[k : k + LEAF]))
        self._build(texts or [""], counts or [0])

    def _build(self, texts: list[str], counts: list[int]) -> None:
        self.size = 1 << max(len(texts) - 1, 0).bit_length()
        self.leaves = texts + [""] * (self.size - len(texts))
        self.chars, self.tokens = np.zeros(2 * self.size, np.int64), np.zeros(2 * self.size, np.int64)
        self.chars[self.size : self.size + len(texts)] = list(map(len, texts))
        self.tokens[self.size : self.size + len(counts)] = counts
        level = self.size
        while level > 1:
            for sums in (self.chars, self.tokens):
                sums[level // 2 : level] = sums[level : 2 * level].reshape(-1, 2).sum(axis=1)
            level //= 2

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    @property
    def length(self) -> int:
        return int(self.chars[1])

    def text(self) -> str:
        return "".join(self.leaves)

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character at (the last one with text for the end), and the place in it."""
        node = 1
        while node < self.size:
            node *= 2
            if at >= self.chars[node] and self.chars[node + 1]:
                at -= int(self.chars[node])
                node += 1
        return node - self.size, at

    def _set(self, leaf: int, text: str, count: int) -> None:
        self.leaves[leaf] = text
        node = leaf + self.size
        dc, dt = len(text) - self.chars[node], count - self.tokens[node]
        while node and (dc or dt):
            self.chars[node] += dc
            self.tokens[node] += dt
            node //= 2

    def _count(self, text: str) -> int:
        self.encoded += len(text)
        return len(self.bpe.encode(text))

    def _next(self, leaf: int, step: int) -> int | None:
        """The nearest leaf with text on that side."""
        leaf += step
        while 0 <= leaf < self.size:
            if self.leaves[leaf]:
                return leaf
            leaf += step
        return None

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces the characters from start to end by new."""
        start = min(max(start, 0), self.length)
        end = min(max(end, start), self.length)
        first, a = self._leaf(start)
        last, b = self._leaf(end)
        own = self.leaves[first][:a] + new + self.leaves[last][b:]
        for k in range(first, last + 1):
            if k != first and self.leaves[k]:
                self._set(k, "", 0)
        # a chunk starts where white space follows something else; else the neighbour belongs to the region
        while (left := self._next(first, -1)) is not None and (not own or own[0] not in SPACES or self.leaves[left][-1] in SPACES):
            own = self.leaves[left] + own
            self._set(first, "", 0)
            first = left
        while (right := self._next(first, 1)) is not None and (not own or own[-1] in SPACES or self.leaves[right][0] not in SPACES):
            own += self.leaves[right]
            self._set(right, "", 0)
        self._set(first, own, self._count(own))
        if len(own) > LONG:
            self._cut(first)

    def _cut(self, leaf: int) -> None:
        chunks = CHUNK.findall(self.leaves[leaf])
        if len(chunks) <= LEAF:
            return
        sizes = [len(x) // 4 for x in self.bpe.of_chunk.get(chunks)]
        groups = range(0, len(chunks), LEAF)
        texts = ["".join(chunks[k : k + LEAF]) for k in groups]
        counts = [sum(sizes[k : k + LEAF]) for k in groups]
        old = self.tokens[self.size :].tolist()
        rows = [(t, c) for t, c in zip(self.leaves[:leaf], old) if t] + list(zip(texts, counts)) + [(t, c) for t, c in zip(self.leaves[leaf + 1 :], old[leaf + 1 :]) if t]
        self._build([t for t, _ in rows], [c for _, c in rows])


Edit = tuple[int, int, str]


def sample_edits(doc_id: int | None, length: int, n: int = 8) -> list[Edit]:
    """Edits that follow from the id alone: insertions, deletions and replacements at hashed places (of the text as it was)."""
    out = []
    for k in range(n):
        h = xxhash.xxh3_64_intdigest(f"{doc_id}/{k}".encode())
        at = h % (length + 1)
        out.append([(at, at, " inserted words, "), (at, at + 7, ""), (at, at + 3, "é\n"), (at, at, "x")][k % 4])
    return out


def applied(text: str, edits: Iterable[Edit]) -> str:
    for start, end, new in edits:
        start = min(max(start, 0), len(text))
        end = min(max(end, start), len(text))
        text = text[:start] + new + text[end:]
    return text


COUNTED = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64()), ("n_edits", pa.int32()), ("n_chars_after", pa.int64()), ("n_tokens_after", pa.int64()), ("n_chars_encoded", pa.int64())])
COUNTED_SQL = "doc_id long, n_chars long, n_tokens long, n_edits int, n_chars_after long, n_tokens_after long, n_chars_encoded long"


def _run(path: str, pattern: str, given: bool):
    def run(batches):
        bpe = tokenizer(path, pattern)

        def rows():
            for doc_id, text, *more in rows_of(batches):
                tree = CountTree(text or "", bpe)
                chars, tokens = tree.length, tree.total
                edits: Sequence = [(e["start"], e["end"], e["text"] or "") for e in more[0] or ()] if given else sample_edits(doc_id, chars)
                for e in edits:
                    tree.edit(*e)
                yield doc_id, chars, tokens, len(edits), tree.length, tree.total, tree.encoded

        yield from batched(rows(), COUNTED)

    return run


def edited_counts(docs: DataFrame, path: str, pattern: str, edits_col: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts before and after each document's edits, and how many characters were encoded for them.

    edits_col: an array of struct<start, end, text>, applied in order; without it, sample_edits().
    """
    ship(docs.sparkSession)
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    if edits_col:
        columns.append(F.col(edits_col).cast("array<struct<start:bigint,end:bigint,text:string>>").alias("edits"))
    return spread(docs.select(*columns)).mapInArrow(_run(path, pattern, bool(edits_col)), COUNTED_SQL)
