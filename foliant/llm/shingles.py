"""Words and word shingles as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
#: Odd factors of the shingle polynomial and of the finishing mix.
BASE, MIX1, MIX2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values; another one for each seed."""
    with np.errstate(over="ignore"):
        x = x + BASE * U(2 * seed + 1)
        x = (x ^ (x >> U(30))) * MIX1
        x = (x ^ (x >> U(27))) * MIX2
        return x ^ (x >> U(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), U, len(words))


def contract_words(text: str) -> list[bytes]:
    """Words between U+0020 and U+0009 to U+000D, with A-Z in lower case."""
    return text.encode("utf-8").lower().split()


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each ``k`` neighbouring words (``len(h) >= k``)."""
    with np.errstate(over="ignore"):
        out = h[: len(h) - k + 1].copy()
        for j in range(1, k):
            out = out * BASE + h[j : len(h) - k + 1 + j]
    return mixed(out, k)


def shingle_set(h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, and where each first starts.

    Fewer than ``k`` words make one shingle of the whole sequence; none, none.
    """
    if not len(h):
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.unique(windows(h, min(k, len(h))), return_index=True)
