"""Spans of bytes, many at once in numpy: where words lie, 64-bit hashes of spans, and a table from hash to number."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: The white space of the word contracts, and A-Z to lower case.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_TABLE = np.random.default_rng(20240901).integers(1, 2**64, 256, dtype=np.uint64)
_P = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, at least ``n`` of them."""
    if len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_P, pow(_P, -1, 2**64))):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=_U)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits; never 0."""
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(32)
    h[h == 0] = 1
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``data[start:end]``; equal bytes have equal hashes wherever they lie."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_TABLE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches without white space."""
    black = np.zeros(len(data) + 2, np.int8)
    black[1:-1] = ~WHITE[data]
    edge = np.diff(black)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class HashTable:
    """Open addressing from 64-bit hashes to numbers; lookups and insertions take arrays. ``bits``: log2 of its slots."""

    def __init__(self, bits: int, kind: type = np.int64):
        self.bits, self.shift, self.mask = bits, _U(64 - bits), (1 << bits) - 1
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.keys, self.values, self.count = np.zeros(1 << self.bits, _U), np.zeros(1 << self.bits, self.kind), 0

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers (0 where absent) and which hashes are absent."""
        slot = (h >> self.shift).astype(np.int64)
        key = self.keys[slot]
        value = self.values[slot]
        open_ = np.flatnonzero(key != h)
        absent = np.zeros(len(h), bool)
        while len(open_):
            none = self.keys[slot[open_]] == 0
            absent[open_[none]] = True
            value[open_[none]] = 0
            open_ = open_[~none]
            slot[open_] = (slot[open_] + 1) & self.mask
            hit = self.keys[slot[open_]] == h[open_]
            value[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit]
        return value, absent

    def insert(self, h: np.ndarray, numbers: np.ndarray) -> None:
        """Hashes must be distinct and absent."""
        slot = (h >> self.shift).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            at, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[at], self.values[at] = h[put], numbers[put]
            placed = np.zeros(len(h), bool)
            placed[put] = True
            left = left[~placed[left]]
            slot[left] = (slot[left] + 1) & self.mask
        self.count += len(h)

    def room(self, n: int) -> bool:
        return 2 * (self.count + n) <= self.mask
