"""64-bit hashes of all words of a text at once, in numpy."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20)
#: A random number for each byte.
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n - 1, modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(n, 1024).bit_length()
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread differences over all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def words(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the runs of bytes that ``inside`` (by byte value) is true of.

    A word's hash depends on its bytes alone: a polynomial of random numbers for the bytes,
    taken from prefix sums and shifted back to the word's start.
    """
    is_in = inside[data]
    edge = np.diff(np.concatenate([[False], is_in, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * powers(_BASE, len(data)), dtype=np.uint64)])
    h = (total[ends] - total[starts]) * powers(_INVERSE, len(data))[starts]
    return starts, ends, mix(h + (ends - starts).astype(np.uint64))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(_BASE) + h[k : len(h) - n + 1 + k])
    return out
