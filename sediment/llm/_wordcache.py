"""A bounded memory of the ids of words, by 64-bit hash, in flat numpy arrays."""

from __future__ import annotations

import numpy as np


def ragged(off: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of runs that start at off and have size values each, one after the other."""
    total = int(size.sum())
    before = np.cumsum(size) - size
    return np.repeat(off - before, size) + np.arange(total)


class WordCache:
    def __init__(self, most: int = 200_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.hash, self.slot = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.off, self.size, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 where unknown."""
        if not len(self.hash):
            return np.full(len(h), -1, dtype=np.int64)
        at = np.searchsorted(self.hash, h)
        at[at == len(self.hash)] = 0
        return np.where(self.hash[at] == h, self.slot[at], -1)

    def add(self, h: np.ndarray, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Slots of new words."""
        slots = len(self.off) + np.arange(len(h))
        self.off = np.concatenate([self.off, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
        hashes, own = np.concatenate([self.hash, h]), np.concatenate([self.slot, slots])
        order = np.argsort(hashes, kind="stable")
        self.hash, self.slot = hashes[order], own[order]
        return slots

    def ids(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and how many each has."""
        size = self.size[slots]
        return self.flat[ragged(self.off[slots], size)], size
