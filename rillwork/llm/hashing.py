"""A hash table of integer keys for numpy look-ups."""

from __future__ import annotations

import numpy as np


def mixed(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class KeyTable:
    """Open addressing: the place of a key among those given, -1 where it is not there. Keys are not negative."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(8, int(len(keys) * 2).bit_length())
        self.keys, self.places = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        slot, todo, self.probes = mixed(keys, self.bits), np.arange(len(keys)), 0
        while len(todo):
            free = todo[self.keys[slot[todo]] == -1]
            self.keys[slot[free]] = keys[free]  # of several for one slot the last one stays
            placed = self.keys[slot[todo]] == keys[todo]
            self.places[slot[todo[placed]]] = todo[placed]
            todo = todo[~placed]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        flat = keys.ravel()
        slot = mixed(flat, self.bits)
        seen = self.keys[slot]
        out = np.where(seen == flat, self.places[slot], -1)
        todo = np.flatnonzero((seen != flat) & (seen != -1))
        for _ in range(1, self.probes):
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slot[todo]]
            hit = seen == flat[todo]
            out[todo[hit]] = self.places[slot[todo[hit]]]
            todo = todo[~hit & (seen != -1)]
        return out.reshape(keys.shape)


class GrowingTable:
    """Open addressing from keys to places that are given with them; more can be added. Keys are not negative."""

    def __init__(self, bits: int = 16):
        self.bits, self.size = bits, 0
        self.keys, self.places = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)

    def add(self, keys: np.ndarray, places: np.ndarray) -> None:
        """Keys are distinct and not in the table yet."""
        if 3 * (self.size + len(keys)) > len(self.keys):
            used = self.keys >= 0
            keys, places = np.concatenate([self.keys[used], keys]), np.concatenate([self.places[used], places])
            self.__init__(int(6 * len(keys)).bit_length())
        slot, todo = mixed(keys, self.bits), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] == -1]
            self.keys[slot[free]] = keys[free]  # of several for one slot the last one stays
            placed = self.keys[slot[todo]] == keys[todo]
            self.places[slot[todo[placed]]] = places[todo[placed]]
            todo = todo[~placed]
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
        self.size += len(keys)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = mixed(keys, self.bits)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.places[slot], -1)
        todo = np.flatnonzero((seen != keys) & (seen != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            seen = self.keys[slot[todo]]
            hit = seen == keys[todo]
            out[todo[hit]] = self.places[slot[todo[hit]]]
            todo = todo[~hit & (seen != -1)]
        return out
