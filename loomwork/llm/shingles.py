"""Sets of word shingles as sorted 64-bit hashes, computed over whole buffers of text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from .rolling import Rolling, mix

#: ASCII white space: what stands between words (fixed values).
GAP = np.zeros(256, bool)
GAP[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Texts are joined to buffers of so many bytes.
BUFFER = 1 << 18


def _buffer_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    data = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    word = np.concatenate([[False], ~GAP[data]])
    edge = np.diff(word.astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(end) < len(start):
        end = np.append(end, len(data))
    roll = Rolling(data, 4)
    words = roll.of(start, end - start)
    length = np.array([len(t) + 1 for t in texts])
    begin = np.cumsum(length) - length
    first = np.searchsorted(start, begin)
    last = np.append(first[1:], len(start))
    # an ordered combination of the words' hashes; windows across two documents are not used
    n = len(words) - width + 1
    whole = np.zeros(max(n, 0), np.uint64)
    for k in range(width):
        whole = mix(whole + words[k : k + max(n, 0)] + np.uint64(k + 1))
    out = []
    for a, b in zip(first, last):
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        elif b > a:
            h = np.zeros(1, np.uint64)
            for k in range(b - a):
                h = mix(h + words[a + k : a + k + 1] + np.uint64(k + 1))
            out.append(mix(h + np.uint64(1000 + b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(rows: Iterable[tuple[object, bytes | None]], width: int) -> Iterator[tuple[object, np.ndarray]]:
    """(key, sorted distinct hashes): width-word shingles, or the whole sequence where there are fewer words."""
    keys, held, total = [], [], 0
    for key, text in rows:
        keys.append(key)
        held.append(text or b"")
        total += len(held[-1])
        if total >= BUFFER:
            yield from zip(keys, _buffer_sets(held, width))
            keys, held, total = [], [], 0
    if held:
        yield from zip(keys, _buffer_sets(held, width))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    k = np.searchsorted(b, a)
    k[k == len(b)] = 0
    return int((b[k] == a).sum())
