"""Words and hashes for Python stages. A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and return."""

from __future__ import annotations

import numpy as np
import xxhash

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xBF58476D1CE4E5B9)


def words(text: str | None, lower: bool = True) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()  # on bytes both know ASCII only


class WordHashes(dict):
    """64-bit hashes by word; forgets all once it holds ``limit`` words, so that memory stays bounded."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), dtype=np.uint64, count=len(ws))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MUL
    return h ^ (h >> np.uint64(29))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, from word hashes; fewer than n words give none."""
    if len(h) < n:
        return np.empty(0, dtype=np.uint64)
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = mixed(out * _MIX + h[i : len(h) - n + 1 + i])
    return out


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """The sorted set of n-word shingles; of fewer words the whole run is the only one; without words it is empty."""
    if not len(h):
        return h
    return distinct(ngrams(h, min(n, len(h))))


def distinct(a: np.ndarray) -> np.ndarray:
    a = np.sort(a)
    return a[np.concatenate(([True], a[1:] != a[:-1]))] if len(a) else a
