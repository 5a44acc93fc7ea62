"""A hash table of 64-bit keys whose lookups are vectorised."""

from __future__ import annotations

import numpy as np

MIX = np.uint64(0x9E3779B97F4A7C15)


class KeyTable:
    """Finds the places of keys in an array of distinct keys. Open addressing; a quarter full at most."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.ascontiguousarray(keys, np.uint64)
        bits = max(8, (4 * len(self.keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.last = (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(self.keys), dtype=np.int64)
        at = self._place(self.keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several keys for a slot the last one stays
            out = self.slots[at] != left
            left, at = left[out], (at[out] + 1) & self.last

    def _place(self, h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (((h ^ (h >> np.uint64(29))) * MIX) >> self.shift).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of these keys, -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(h), -1, np.int32)
        at = self._place(h)
        out = self.slots[at]
        left = np.flatnonzero((out >= 0) & (self.keys[out] != h))
        while len(left):
            at[left] = (at[left] + 1) & self.last
            out[left] = self.slots[at[left]]
            left = left[(out[left] >= 0) & (self.keys[out[left]] != h[left])]
        return out


class Numbers(dict):
    """Numbers keys as they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n
