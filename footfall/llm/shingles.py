"""Sets of word shingles as sorted 64-bit numbers, made inside Arrow batches."""

from __future__ import annotations

import hashlib

import numpy as np

# Words whose numbers a worker remembers; beyond it the memory is emptied and filled anew.
REMEMBERED = 300_000
_FACTORS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64
)
_known: dict[bytes, int] = {}


def word_numbers(words: list[bytes]) -> np.ndarray:
    """A 64-bit number for each word, equal for equal words on every machine."""
    try:
        return np.array([_known[w] for w in words], np.uint64)
    except KeyError:
        if len(_known) > REMEMBERED:
            _known.clear()
        for w in set(words).difference(_known):
            _known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        return np.array([_known[w] for w in words], np.uint64)


def mixed(numbers: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers over the whole range."""
    numbers = (numbers ^ (numbers >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    numbers = (numbers ^ (numbers >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return numbers ^ (numbers >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted numbers of the distinct shingles of ``width`` words, A-Z lower-cased.

    Fewer words are one shingle as a whole; no words give an empty set.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    numbers = word_numbers(words)
    length = min(width, len(words))
    n = len(words) - length + 1
    total = np.full(n, length, np.uint64)
    for k in range(length):
        total = total * _FACTORS[0] + numbers[k : k + n] * _FACTORS[1 + k % 4]
    return np.unique(mixed(total))
