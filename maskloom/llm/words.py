"""Hashes of words and of runs of words, for whole batches of texts at once.

A word is a run of bytes other than blank, tab to carriage return. Its hash is a polynomial of its
bytes modulo 2**64, mixed; runs of words combine mixed hashes. Equal words have equal hashes;
unequal ones differ but for a chance of about 2**-64 a pair.
"""

from __future__ import annotations

import functools

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD1342543DE82EF95
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in ``data``, and for each text its first word (one more at the end)."""
    word = ~_SPACE[data]
    fresh = np.ones(len(data) + 1, bool)
    fresh[1:-1] = _SPACE[data[:-1]]
    fresh[offsets] = True
    starts = np.flatnonzero(word & fresh[:-1])
    after = np.ones(len(data), bool)
    after[:-1] = _SPACE[data[1:]]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(1 << max(16, int(len(data)).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    with np.errstate(over="ignore"):
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` words from each place on; texts are not told apart."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, size):
        out *= np.uint64(_STEP)
        out += words[i : i + n]
    return mix(out)
