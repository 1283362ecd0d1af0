"""Word shingles of texts as 64-bit hashes, computed a text at a time inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

SIZE = 5
CACHE_WORDS = 200_000
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hash of each word's bytes, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def split_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text with A-Z lowered; bytes methods know ASCII only."""
    return text.lower().split() if text else []


def sequence_hashes(h: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Hash of every run of ``size`` words in order; of all words where there are fewer, none for none."""
    n = len(h)
    if n == 0:
        return h
    if n < size:
        size = n
    with np.errstate(over="ignore"):
        out = h[: n - size + 1].copy()
        for k in range(1, size):
            out = out * _MULTIPLY + h[k : n - size + 1 + k]
        return mix(out + np.uint64(size))


def shingle_set(text: bytes | None) -> np.ndarray:
    """Distinct shingles of a text, sorted."""
    s = np.sort(sequence_hashes(word_hashes(split_words(text))))
    if len(s) < 2:
        return s
    fresh = np.empty(len(s), bool)
    fresh[0] = True
    np.not_equal(s[1:], s[:-1], out=fresh[1:])
    return s[fresh]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
