"""Polynomial hashes of substrings, shared by the operators that compare runs of bytes."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15


class PolynomialHash:
    """Hashes modulo 2**64 of substrings, from prefix sums of byte * BASE**position."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(self.up) <= n:
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                steps = np.full(n + n // 4 + 64, base, np.uint64)
                steps[0] = 1
                setattr(PolynomialHash, name, np.multiply.accumulate(steps))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))
