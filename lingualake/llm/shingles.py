"""Word shingles as 64-bit numbers, for operators that compare texts by sets of them."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import Remembered, held

WORDS = 5
_MEMORY = 300_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_numbers(words: list[bytes]) -> np.ndarray:
    known = held(("shingles",), lambda: Remembered(xxhash.xxh3_64_intdigest, _MEMORY))
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def runs(numbers: np.ndarray, size: int = WORDS) -> np.ndarray:
    """A number for each run of `size` words; for fewer words one for them all, none for none."""
    size = min(size, len(numbers))
    if not size:
        return numbers
    n = len(numbers) - size + 1
    out = np.full(n, np.uint64(size))
    for k in range(size):
        out = mixed(out * _PRIME + numbers[k : k + n])
    return out


def shingle_set(text: bytes, size: int = WORDS) -> np.ndarray:
    """The sorted distinct shingles of a text's words, split at ASCII white space, A-Z in lower case."""
    return np.unique(runs(word_numbers(text.lower().split()), size))
