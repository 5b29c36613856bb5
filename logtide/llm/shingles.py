"""Word shingles of whole texts as 64-bit hashes, in array operations over the bytes of a text."""

from __future__ import annotations

import numpy as np

_M = np.uint64(0xFF51AFD7ED558CCD)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _M
    return x ^ (x >> np.uint64(29))


class _Powers:
    """Powers of a base modulo 2^64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.values = base, np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.values) < n:
            self.values = np.concatenate([self.values, self.values * np.uint64(pow(self.base, len(self.values), 1 << 64))])
        return self.values[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(_INVERSE)


def word_hashes(text: str) -> np.ndarray:
    """A hash for each word `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, in order."""
    data = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    if not len(data):
        return np.zeros(0, dtype=np.uint64)
    word = np.concatenate([[False], ~_BLANK[data], [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, stops = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP.upto(len(data)))])
    return mixed((total[stops] - total[starts]) * _DOWN.upto(len(data))[starts] + (stops - starts).astype(np.uint64) * _M)


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of `words` words; of the whole sequence if there are fewer; empty without words."""
    hashes = word_hashes(text) if text else np.zeros(0, dtype=np.uint64)
    if not len(hashes):
        return hashes
    width = min(words, len(hashes))
    rolled = np.full(len(hashes) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        rolled = mixed(rolled * np.uint64(31) + hashes[i : len(hashes) - width + 1 + i])
    return np.unique(rolled)
