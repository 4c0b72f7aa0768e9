"""Sets of word shingles as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from lexweave.llm.common import remembers

WIDTH = 5
_REMEMBERED = 200_000
#: Odd multipliers that mix the hashes of a shingle's words.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_words = _Words()
remembers(__name__, _words.clear)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles of a text, A-Z lower-cased: five words each, the whole sequence where there are fewer, none without
    words. bytes.lower() and bytes.split() know ASCII letters and blanks only, which is the word rule."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = max(1, len(words) - WIDTH + 1)
    rows = hashes[:size] * _MIX[0] + np.uint64(min(len(words), WIDTH))
    for i in range(1, min(len(words), WIDTH)):
        rows = (rows ^ (rows >> np.uint64(29))) * _MIX[i] + hashes[i : i + size]
    rows ^= rows >> np.uint64(32)
    return np.unique(rows * _MIX[0])


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed longs."""
    high, low = divmod(xxhash.xxh3_128_intdigest(shingles.tobytes()), 1 << 64)
    return high - (1 << 63), low - (1 << 63)
