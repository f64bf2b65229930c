"""Vectorised word and shingle hashing over whole Arrow batches.

A word is a run of bytes other than space and 0x09 to 0x0D. Words of a whole batch are hashed at
once: with weights ``B**i`` a prefix sum over the bytes gives every word's polynomial as a
difference of two sums, made independent of its place by the inverse power. All arithmetic is
modulo 2**64.
"""

from __future__ import annotations

import numpy as np

M64 = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text handled at once; bounds the working memory of a task.
SLICE = 1 << 20

_pow = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)``; the table is kept and doubled as longer texts come."""
    have = _pow.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE + 4096)
        have = np.empty(size, np.uint64)
        have[0] = 1
        k = 1
        while k < size:
            m = min(k, size - k)
            with np.errstate(over="ignore"):
                have[k : k + m] = have[:m] * np.uint64(pow(base, k, 1 << 64))
            k += m
        _pow[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)
_lower = _codes.copy()
_lower[65:91] = _codes[97:123]
_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
#: Odd factors of the words of a shingle, by place.
PLACE = mix(np.arange(1001, 1001 + 64, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)


def spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _space):
    """Starts and ends of all words, and the n + 1 places of the rows among the words."""
    solid = ~space[data]
    n = len(data)
    inner = offsets[(offsets > 0) & (offsets < n)]
    first, last = solid.copy(), solid.copy()
    if n:
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        first[inner] = solid[inner]
        last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, space: np.ndarray = _space):
    """Hashes of all words, starts, ends, and the places of the rows among the words."""
    starts, ends, rows = spans(data, offsets, space)
    value = (_lower if lower else _codes)[data]
    value *= powers(BASE, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value, out=sums[1:])
    found = (sums[ends] - sums[starts]) * powers(INVERSE, len(data) + 1)[starts]
    return mix(found), starts, ends, rows


def runs(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of the k words from each place on (the last k - 1 places are left out)."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(m, (k * 0x51ED27F5 + salt * 0xD6E8FEB86659FD93) & M64, np.uint64)
    for j in range(k):
        total += hashes[j : j + m] * PLACE[j]
    return mix(total)


def sequence(hashes: np.ndarray) -> np.uint64:
    """Hash of a whole sequence of fewer words than a shingle has."""
    return runs(hashes, len(hashes))[0]


def polynomial_runs(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """As ``runs`` for a large k, in time independent of k, by prefix sums."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    h = mix(hashes + np.uint64((salt * 0xA24BAED4963EE407 + 0x9FB21C651E98DF25) & M64))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * powers(BASE, n), out=sums[1:])
    return mix((sums[k:] - sums[: n - k + 1]) * powers(INVERSE, n)[: n - k + 1] + np.uint64(k))
