"""64-bit hashes of words and of all their runs of a given length, by numpy.

A run's hash is the polynomial of its words' hashes in an odd base modulo
2**64, taken from prefix sums and mixed, so that all runs of a text cost a few
vector operations whatever their length.
"""

from __future__ import annotations

import numpy as np
import xxhash

from ._shared import hold

CACHE_ENTRIES, CACHE_BYTES = 200_000, 48
MASK = (1 << 64) - 1
#: Two odd bases, from the digits of pi and e.
BASES = (0x243F6A8885A308D3, 0xB7E151628AED2A6B)


class _Words(dict):
    """Word (bytes) -> 64-bit hash, in a bounded cache."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHE_BYTES:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = h
        return h


_words = _Words()
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    hold("words", _words.clear)
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers that spreads low and high bits alike."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        size = max(4096, 2 * n)
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        known = _powers[base] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return known[0][:n], known[1][:n]


def run_hashes(words: np.ndarray, length: int, base: int = BASES[0]) -> np.ndarray:
    """The hash of every run of ``length`` words, by its start; empty if there are fewer words."""
    n = len(words)
    if n < length:
        return np.zeros(0, np.uint64)
    up, down = _power(base, n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up, dtype=np.uint64, out=total[1:])
    return mix((total[length:] - total[:-length]) * down[: n - length + 1])


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """min or max of each ``width`` values in a row, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[:-step], out[step:])
        have += step
    return out


def minima(values: np.ndarray, width: int) -> np.ndarray:
    """Positions of the values that are the smallest of some ``width`` in a row; ties all count."""
    if len(values) < width:
        return np.zeros(0, np.int64)
    least = sliding(values, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    largest = sliding(np.concatenate([pad, least, pad]), width, np.maximum)
    return np.flatnonzero(values == largest)
