"""Stable 64-bit hashes of words and of runs of words, many documents at a time."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
#: The word separators [\x20\x09-\x0D].
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """At least ``n`` powers of ``base`` modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = 1 << max(n, 1 << 16).bit_length()
        factors = np.full(size, base & (2**64 - 1), dtype=np.uint64)
        factors[0] = 1
        _powers[base] = known = np.multiply.accumulate(factors)
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums that give the hash of any range by one subtraction and product: see ``range_hash``."""
    sums = np.empty(len(values) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(values * powers(_INVERSE, len(values)), out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [start, end); equal ranges hash alike wherever they are."""
    return mix((sums[end] - sums[start]) * powers(_BASE, len(sums))[start])


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte after its last."""
    blank = np.concatenate(([True], BLANK[data], [True]))
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    return edge[0::2], edge[1::2]


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word."""
    data = np.frombuffer(text, dtype=np.uint8)
    start, end = word_bounds(data)
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    sums = prefix_sums(data.astype(np.uint64) + np.uint64(1))
    return range_hash(sums, start, end) ^ mix((end - start).astype(np.uint64))


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` consecutive words."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    sums = prefix_sums(words)
    return mix((sums[n:] - sums[:-n]) * powers(_BASE, len(sums))[:-n])
