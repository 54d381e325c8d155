"""Words and hashes shared by the text operators.

A word is a maximal run of bytes other than space and the control characters 9 to 13; these are
exactly the separators of ``bytes.split()``, so a text is split without a regular expression. UTF-8
keeps every byte of a non-ASCII character above 0x7F, hence splitting bytes and characters agrees.
"""

from __future__ import annotations

import numpy as np
import xxhash

CACHE_WORDS = 300_000


def encode(text: str | None) -> bytes:
    """UTF-8 bytes of a text; a null text is empty, a lone surrogate becomes '?'."""
    return b"" if text is None else text.encode("utf-8", "replace")


class WordHashes(dict):
    """64-bit hash of each word, remembered for at most ``CACHE_WORDS`` words at a time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; a shorter text is one run, no word none."""
    if not len(hashes):
        return hashes
    n = max(1, len(hashes) - size + 1)
    width = min(size, len(hashes))
    out = np.full(n, np.uint64(width), np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return np.unique(out)
