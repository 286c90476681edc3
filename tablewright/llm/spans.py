"""Words of UTF-8 texts as NumPy spans and hashes, for Arrow tasks."""

from __future__ import annotations

import numpy as np

#: Odd multipliers of the two word hashes, and their inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)

_IS_GAP = np.zeros(256, dtype=bool)
_IS_GAP[[0x20, *range(0x09, 0x0E)]] = True


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end byte of each word of a text (uint8)."""
    inside = np.concatenate(([False], ~_IS_GAP[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer over uint64, so that sums of powers spread over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Powers:
    """Powers of the multipliers and of their inverses, grown to the longest text seen."""

    def __init__(self) -> None:
        self.size = 0
        self.up: list[np.ndarray] = []
        self.down: list[np.ndarray] = []

    def upto(self, n: int) -> Powers:
        if n > self.size:
            self.size = max(n, 2 * self.size, 1 << 16)

            def table(base: int) -> np.ndarray:
                factors = np.full(self.size, base, dtype=np.uint64)
                factors[0] = 1
                return np.multiply.accumulate(factors)

            self.up = [table(b) for b in BASES]
            self.down = [table(b) for b in INVERSES]
        return self


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers, which: int) -> np.ndarray:
    """A 64-bit hash of each word: the polynomial of its bytes, by prefix sums, then mixed."""
    powers.upto(len(data) + 1)
    terms = (data.astype(np.uint64) + np.uint64(1)) * powers.up[which][:len(data)]
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(terms, dtype=np.uint64)))
    return mix((sums[ends] - sums[starts]) * powers.down[which][starts] + (ends - starts).astype(np.uint64))


def window_hashes(hashes: np.ndarray, size: int, powers: Powers, which: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` consecutive word hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    powers.upto(len(hashes) + 1)
    terms = hashes * powers.up[which][:len(hashes)]
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(terms, dtype=np.uint64)))
    return mix((sums[size:] - sums[:-size]) * powers.down[which][:n])
