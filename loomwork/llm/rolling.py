"""Vectorised polynomial hashes modulo 2**64 of all stretches of a byte buffer, from prefix sums."""

from __future__ import annotations

import numpy as np

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the word (the multiply and shift steps of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Rolling:
    """Prefix sums of a byte buffer under an odd base; of(start, length) is position-independent."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int = 1):
        base = 0x9E3779B97F4A7C15 * (2 * seed + 1) % 2**64 | 5
        self.up, self.down = self._grown(base, len(data) + 1)
        letters = mix(np.arange(1, 257, dtype=U) * U(base))
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(letters[data] * self.up[: len(data)], out=self.sums[1:])

    @classmethod
    def _grown(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._powers.get(base)
        if have is None or len(have[0]) < n:
            size = max(1 << 18, 1 << (n - 1).bit_length())
            made = []
            for b in (base, pow(base, -1, 2**64)):
                p = np.full(size, b, U)
                p[0] = 1
                np.cumprod(p, out=p)
                made.append(p)
            if size > 1 << 20:  # not worth keeping
                return tuple(made)
            cls._powers[base] = have = tuple(made)
        return have

    def of(self, start: np.ndarray, length) -> np.ndarray:
        """Mixed hashes of the stretches; start and length: arrays, or a number for length."""
        return mix((self.sums[start + length] - self.sums[start]) * self.down[start])

    def all(self, length: int) -> np.ndarray:
        """Mixed hashes of every stretch of that length."""
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, U)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values, by doubling."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x
