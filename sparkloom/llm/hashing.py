"""Hashes of all substrings of a buffer of bytes, by prefix sums modulo 2**64."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_VALUE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all."""
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n."""
    if len(_powers[0]) <= n:
        size = 1 << n.bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


class Substrings:
    def __init__(self, buffer: np.ndarray):
        up, self.down = powers(len(buffer) + 1)
        self.sums = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum(_VALUE[buffer] * up[: len(buffer)], out=self.sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the substrings from start to end; equal strings of equal length have equal ones."""
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def all_of(self, size: int) -> np.ndarray:
        """Hashes of all substrings of this size."""
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * self.down[:n]
