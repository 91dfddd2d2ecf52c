"""64-bit hashes of words and of word sequences, vectorised over a text."""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 20
U64 = np.uint64
BASE = 0x9E3779B97F4A7C15

# Words are runs of other bytes than these.
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2 to the 64th."""

    def __init__(self):
        self._n = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self._n:
            self._n = max(n, 1 << 16)
            self._up = self._row(BASE | 1)
            self._down = self._row(pow(BASE | 1, -1, 1 << 64))
        return self._up[:n], self._down[:n]

    def _row(self, base: int) -> np.ndarray:
        row = np.full(self._n, base, U64)
        row[0] = 1
        return np.multiply.accumulate(row)


powers = _Powers()


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and start of every word of a text in UTF-8."""
    found, places, at = [], [], 0
    while at < len(raw):
        end = min(len(raw), at + CHUNK)
        while end < len(raw) and not _IS_SPACE[raw[end]]:
            end += 1
        data = np.frombuffer(raw, np.uint8, end - at, at)
        inside = ~_IS_SPACE[data]
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = powers.upto(len(data))
        sums = np.concatenate([[U64(0)], np.cumsum((data.astype(U64) + U64(1)) * up)])
        words = (sums[stops] - sums[starts]) * down[starts]
        found.append(mixed(words + (stops - starts).astype(U64) * U64(BASE)))
        places.append(starts + at)
        at = end
    if not found:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(places)
