"""Stable 64-bit hashes of words and of the word shingles of texts."""

from __future__ import annotations

import numpy as np
import xxhash

from riskweave.llm.common import numbered

#: Odd factor of the polynomial over word hashes.
FACTOR = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A hash per word; each distinct word is hashed once."""
    if not words:
        return np.zeros(0, np.uint64)
    ids, distinct = numbered(words)
    return np.array([xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()], np.uint64)[ids]


def gram_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words; runs of other widths get other hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total = total * np.uint64(FACTOR) + hashes[k : k + n]
    return mixed(total)


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Distinct shingles in ascending order; a shorter text is one shingle, no words are none."""
    return np.unique(gram_hashes(hashes, min(width, max(1, len(hashes)))))
