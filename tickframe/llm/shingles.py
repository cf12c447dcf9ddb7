"""Word shingles as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from tickframe.llm.common import worker_state

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, remembered; ``limit`` bounds the memory only."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words of UTF-8 text, cut at the space and at 0x09-0x0D."""
    return text.lower().split()


def word_hashes(text: bytes) -> np.ndarray:
    hashes = worker_state("word hashes", WordHashes)
    return np.array(list(map(hashes.__getitem__, words(text))), np.uint64)


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct ``size``-word shingles; with fewer words the whole sequence as one; else empty."""
    h = word_hashes(text or b"")
    if not len(h):
        return h
    n = min(size, len(h))
    x = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        x = scramble(x * _MULTIPLIER + h[i:len(h) - n + 1 + i])
    return np.unique(x)
