"""Counter-based random numbers that are the same in Catalyst and in numpy: XXH64 over (seed, operator, row, epoch, count)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_ALL = (1 << 64) - 1
# The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def _spread(h):
    """The last mixing of XXH64, of whole numbers or arrays of unsigned ones."""
    if isinstance(h, np.ndarray):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(_P2)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(_P3)
        return h ^ (h >> np.uint64(32))
    h = (h ^ h >> 33) * _P2 & _ALL
    h = (h ^ h >> 29) * _P3 & _ALL
    return h ^ h >> 32


def _turned(h: int, n: int) -> int:
    return (h << n | h >> 64 - n) & _ALL


def hash_long(v: int, seed: int) -> int:
    """XXH64 of eight bytes."""
    h = (seed + _P5 + 8 & _ALL) ^ _turned((v & _ALL) * _P2 & _ALL, 31) * _P1 & _ALL
    return _spread(_turned(h, 27) * _P1 + _P4 & _ALL)


def hash_int(v: int, seed: int) -> int:
    """XXH64 of four bytes."""
    h = (seed + _P5 + 4 & _ALL) ^ (v & 0xFFFFFFFF) * _P1 & _ALL
    return _spread(_turned(h, 23) * _P2 + _P3 & _ALL)


def hash_ints(v: np.ndarray, seed: int) -> np.ndarray:
    """hash_int of an array of numbers from 0 to 2^32 - 1."""
    h = np.uint64(seed + _P5 + 4 & _ALL) ^ v.astype(np.uint64) * np.uint64(_P1)
    h = (h << np.uint64(23) | h >> np.uint64(41)) * np.uint64(_P2) + np.uint64(_P3)
    return _spread(h)


def _literal(v: int, seed: int) -> int:
    """A whole number hashed as Spark takes it for a literal: four bytes if they do, else eight."""
    return hash_int(v, seed) if -(1 << 31) <= v < 1 << 31 else hash_long(v, seed)


class Draw:
    """The k-th random number of an op for each row, as a column: a hash of seed, op, row and epoch, whatever the partitioning."""

    def __init__(self, seed: int, position: int, key: Column, epoch: int) -> None:
        self.parts = (F.lit(int(seed)), F.lit(position), key.cast("bigint"), F.lit(int(epoch)))

    def __call__(self, k: int, n: int | None = None) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(*self.parts, F.lit(k)), 11)  # 53 bits, exact as a double
        share = bits.cast("double") / float(1 << 53)
        return share if n is None else F.floor(share * n).cast("int")

    def between(self, k: int, value) -> Column:
        low, high = value if isinstance(value, Sequence) else (value, value)
        return self(k) * float(high - low) + float(low)


class Numbers:
    """Draw's numbers for one row, one after the other; each call takes the next, or the next as the seed of as many as it needs."""

    def __init__(self, seed: int, position: int, key: int, epoch: int = 0) -> None:
        self.base = _literal(int(epoch), hash_long(int(key), hash_int(position, _literal(int(seed), 42))))
        self.count = 0

    def _next(self) -> int:
        self.count += 1
        return hash_int(self.count - 1, self.base)

    def random(self) -> float:
        return (self._next() >> 11) / float(1 << 53)

    def many(self, n: int) -> np.ndarray:
        return (hash_ints(np.arange(n), self._next()) >> np.uint64(11)).astype(np.float64) / float(1 << 53)

    def integers(self, low: int, high: int) -> int:
        """From low to high - 1."""
        return low + int(np.floor(self.random() * (high - low)))

    def uniform(self, low: float, high: float) -> float:
        return self.random() * float(high - low) + float(low)

    def normal(self, mean: float, deviation: float, shape: Sequence[int]) -> np.ndarray:
        """By Box and Muller: two numbers give two."""
        n = int(np.prod(shape))
        u = self.many(2 * -(-n // 2)).reshape(2, -1)
        far, turn = np.sqrt(-2 * np.log(1 - u[0])), 2 * np.pi * u[1]
        return mean + deviation * np.concatenate([far * np.cos(turn), far * np.sin(turn)])[:n].reshape(shape)

    def permutation(self, n: int) -> np.ndarray:
        return np.argsort(self.many(n), kind="stable")

    def choice(self, n: int, size: int, repeat: bool, weights: np.ndarray) -> list[int]:
        """Numbers below n by weight; without repeats, what was drawn has no weight any more."""
        left, out = np.asarray(weights, float).copy(), []
        for u in self.many(size):
            ends = np.cumsum(left)
            out.append(int(min(np.searchsorted(ends, u * ends[-1], "right"), np.flatnonzero(left).max())))
            if not repeat:
                left[out[-1]] = 0
        return out
