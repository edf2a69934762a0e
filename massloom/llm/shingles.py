"""Word shingles as sets of 64-bit hashes, and their minwise signatures."""

from __future__ import annotations

import numpy as np
import xxhash

_WORDS: dict[bytes, int] = {}
_WORD_ENTRIES = 500_000
_MULTIPLIERS = np.random.default_rng(20_240_101).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _hash_word(word: bytes) -> int:
    value = xxhash.xxh3_64_intdigest(word)
    if len(_WORDS) < _WORD_ENTRIES and len(word) <= 32:
        _WORDS[word] = value
    return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; a text with fewer words is one shingle, one without words has none.

    A-Z are lower-cased; words are runs of bytes other than ASCII white space.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    get = _WORDS.get
    hashes = np.fromiter((get(w) or _hash_word(w) for w in words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(hashes) - width + 1
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total += hashes[i : i + n] * _MULTIPLIERS[i]
    return np.unique(_mixed(total))


class MinHash:
    """``size`` minwise tokens of 32 bits of a set of 64-bit hashes, taken in blocks of bounded memory."""

    def __init__(self, size: int, seed: int = 1):
        draw = np.random.default_rng(seed)
        self.size = size
        self._a = draw.integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._b = draw.integers(0, 1 << 63, size, dtype=np.uint64)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        least = np.full(self.size, np.iinfo(np.uint32).max, np.uint32)
        for low in range(0, len(values), 1024):
            mixed = values[low : low + 1024, None] * self._a + self._b
            np.minimum(least, (mixed >> np.uint64(32)).astype(np.uint32).min(axis=0), out=least)
        return least
