"""Hashes of pieces of text as arrays, and a table from hashes to row numbers."""

from __future__ import annotations

from functools import cache

import numpy as np

BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        x = np.full(n, b, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return tuple(out)


def piece_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes, never 0, of values[start[i]:end[i]]; values: a random odd number for each character.

    They are sums of values times powers of an odd number, so two pieces of thousands of characters can be made to collide on purpose.
    """
    # the powers of usual sizes are kept; those of longer texts aren't
    up, down = _powers(1 << 19) if len(values) <= 1 << 19 else _powers.__wrapped__(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    h = mix((sums[end] - sums[start]) * down[start])
    return np.where(h == 0, np.uint64(1), h)


class HashRows:
    """Row numbers by 64-bit hash (never 0), with open addressing; find and put work on arrays."""

    def __init__(self, slots: int = 1 << 16):
        self.keys, self.rows, self.n = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Rows of these hashes, -1 for unknown ones."""
        mask = np.int64(len(self.keys) - 1)
        slot = (h & np.uint64(mask)).astype(np.int64)
        got = self.keys[slot]
        out = np.where(got == h, self.rows[slot], -1)
        left = np.flatnonzero((got != h) & (got != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & mask
            got = self.keys[slot[left]]
            same = got == h[left]
            out[left[same]] = self.rows[slot[left[same]]]
            left = left[~same & (got != 0)]
        return out

    def add(self, h: np.ndarray) -> None:
        """Gives distinct new hashes the next row numbers."""
        rows = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.n += len(h)
        if 2 * self.n > len(self.keys):
            old, old_rows = self.keys, self.rows
            size = len(old)
            while 2 * self.n > size:
                size *= 2
            self.keys, self.rows = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            held = np.flatnonzero(old)
            self._put(old[held], old_rows[held])
        self._put(h, rows)

    def _put(self, h: np.ndarray, rows: np.ndarray) -> None:
        mask = np.int64(len(self.keys) - 1)
        slot = (h & np.uint64(mask)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = h[free]  # of several in one slot the last stays
            won = free[self.keys[slot[free]] == h[free]]
            self.rows[slot[won]] = rows[won]
            left = left[self.keys[slot[left]] != h[left]]
            slot[left] = (slot[left] + 1) & mask
