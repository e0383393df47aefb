"""Vectorised polynomial hashes over 64-bit tokens."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 5
_SEED = 0xD1B54A32D192ED03
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 18, 1 << (n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        up, down = np.full(size, base, U64), np.full(size, inverse, U64)
        up[0] = down[0] = 1
        have = _powers[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


def prefix(tokens: np.ndarray, base: int = BASE) -> np.ndarray:
    """Prefix sums whose differences, scaled, are the hashes of token ranges."""
    out = np.zeros(len(tokens) + 1, U64)
    np.cumsum(tokens * powers(len(tokens) + 1, base)[0][: len(tokens)], out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hashes of the ranges [start, end): equal ranges have equal hashes wherever they stand."""
    return (sums[end] - sums[start]) * powers(len(sums), base)[1][start]


BYTE_TOKENS = mix(np.arange(1, 257, dtype=U64) * U64(_SEED))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of concatenated texts, and how many words lie before each text."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    inside = ~space
    opens = inside.copy()
    opens[1:] &= space[:-1]
    closes = inside.copy()
    closes[:-1] &= space[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    opens[cuts] = inside[cuts]
    closes[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes."""
    sums = prefix(BYTE_TOKENS[data])
    return mix(span(sums, starts, ends) + (ends - starts).astype(U64) * U64(_SEED))
