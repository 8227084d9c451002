"""Cutting a text where white space follows other characters, and tokens of the pieces from a bounded cache.

The patterns of both tokenizers never match across such a place: their classes hold either white
space or none, and a match that begins with one white-space character begins there.  A text's ids
are therefore the ids of its chunks, one after the other, and a chunk that came before costs one
lookup.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: White space as Unicode's property has it (fixed values).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space and what follows it up to the next white space.
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
WORD = re.compile(f"[^{SPACE}]+")


class ChunkCache:
    """chunk to the bytes that encode() makes of it, for lists of chunks.

    Two generations of ``limit`` / 2 bytes each: when the young one is full it becomes the old one, and
    what comes again moves back, so frequent chunks stay.
    """

    ENTRY = 200  # bytes of an entry besides its characters

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 128 << 20):
        self.encode, self.limit, self.young, self.old, self.bytes = encode, limit, {}, {}, 0

    def get(self, chunks: list[str]) -> list[bytes]:
        young, old = self.young, self.old
        missing = [c for c in set(chunks) if c not in young]
        if missing:
            new = [c for c in missing if c not in old]
            young.update((c, old[c]) for c in missing if c in old)
            young.update(zip(new, self.encode(new)) if new else ())
            self.bytes += sum(map(len, missing)) + sum(len(young[c]) for c in missing) + self.ENTRY * len(missing)
        out = list(map(young.__getitem__, chunks))
        if 2 * self.bytes > self.limit:
            self.old, self.young, self.bytes = young, {}, 0
        return out


def spans(text: str, size: int = 1 << 20):
    """Parts of a long text, each of whole chunks, so that the lists of chunks stay small."""
    at = 0
    while len(text) - at > size:
        cut = at + size
        found = None
        for m in re.finditer(f"[^{SPACE}](?=[{SPACE}])", text[at:cut]):
            found = m.end()
        if found is None:
            m = re.compile(f"[^{SPACE}](?=[{SPACE}])").search(text, cut - 1)
            if m is None:
                break
            found = m.end() - at
        yield text[at : at + found]
        at += found
    yield text[at:]
