"""Words and shingles of texts as flat numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

MULTIPLIERS = np.random.default_rng(20240501).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """64-bit hash of each word, remembered up to a bound."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, in place on a fresh array."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def flat_hashes(words_of: list[list[bytes]], memo: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """All word hashes one after another, and the number of words of each text."""
    counts = np.fromiter(map(len, words_of), np.int64, len(words_of))
    look = memo.__getitem__
    flat = np.fromiter((h for words in words_of for h in map(look, words)), np.uint64, int(counts.sum()))
    return flat, counts


def shingle_sets(words_of: list[list[bytes]], width: int, memo: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, and the size of each set.

    A text with fewer words than `width` has its whole sequence as one shingle; one without words has none.
    """
    flat, counts = flat_hashes(words_of, memo)
    ends = np.cumsum(counts)
    starts = ends - counts
    hashed = np.zeros(len(flat), np.uint64)
    whole = len(flat) - width + 1
    if whole > 0:
        for k in range(width):
            hashed[:whole] += flat[k:whole + k] * MULTIPLIERS[k]
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(flat)) <= (ends - width)[owner]
    short = np.flatnonzero((counts > 0) & (counts < width))
    for i in short:
        words = flat[starts[i]:ends[i]]
        hashed[starts[i]] = (words * MULTIPLIERS[:len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))
    inside[starts[short]] = True
    hashed, owner = mix(hashed[inside]), owner[inside]
    order = np.lexsort((hashed, owner))
    hashed, owner = hashed[order], owner[order]
    fresh = np.ones(len(hashed), bool)
    fresh[1:] = (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])
    return hashed[fresh], np.bincount(owner[fresh], minlength=len(counts))
