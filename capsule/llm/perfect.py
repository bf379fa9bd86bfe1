"""Minimal perfect hashing of distinct 64-bit keys: levels of bits, each key alone at its place of one level."""

from __future__ import annotations

import numpy as np

from capsule.llm.hashed import mixed

_STEP = 0x9E3779B97F4A7C15


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mixed(keys + np.uint64((level + 1) * _STEP % (1 << 64))) % np.uint64(size)).astype(np.int64)


def build(keys: np.ndarray) -> list[np.ndarray]:
    """Levels (64-bit words) for distinct keys. Keys that share a place of a level go on to the next one."""
    levels, left = [], keys
    while len(left):
        size = -(-len(left) // 64) * 64
        at = _places(left, len(levels), size)
        times = np.bincount(at, minlength=size)
        levels.append(np.packbits(times == 1, bitorder="little").view(np.uint64))
        left = left[times[at] > 1]
    return levels


class PerfectHash:
    """Slots 0..n-1 of the n keys that `levels` were built for; any other key gets some slot or -1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels, self.n = [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.levels.append((words, self.n + np.cumsum(ones) - ones))
            self.n += int(ones.sum())

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (words, before) in enumerate(self.levels):
            if not len(left):
                break
            at = _places(keys[left], level, 64 * len(words))
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            lower = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = before[at[hit] >> 6] + lower[hit]
            left = left[~hit]
        return out
