"""Words of many texts hashed at once with numpy, for use inside tasks.

Texts are laid side by side as bytes; a word's hash is a polynomial of its bytes modulo 2**64, found from running sums,
then mixed with its length. Hashes have 64 bits and stand for the words wherever sets are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text laid side by side at a time (a longer text is taken alone). What is derived from them takes about 100 times
#: as much memory in a Python worker, of which each core of an executor has one.
BLOCK = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 2 * BLOCK), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def blocks(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Texts (nulls as empty) in runs of about BLOCK bytes, each with the index of its first."""
    held, size, start = [], 0, 0
    for i, t in enumerate(texts.cast(pa.large_string()).cast(pa.large_binary())):
        held.append(t.as_py() or b"")
        size += len(held[-1])
        if size >= BLOCK:
            yield start, held
            held, size, start = [], 0, i + 1
    if held:
        yield start, held


class Words:
    """The words of some texts: `hash`, `doc` (index of the text), and `first[i]:first[i + 1]`, the words of text i."""

    def __init__(self, texts: list[bytes], lower: bool):
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        if lower:
            data = LOWER[data]
        space = SPACE[data]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        self.start, self.end = edge[0::2], edge[1::2]
        self.data = data
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.start, np.concatenate(([0], ends)))
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hash = self._hash(data.astype(np.uint64) + np.uint64(1), self.start, self.end)

    @staticmethod
    def _hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        up, down = powers(len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=sums[1:])
        return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))

    def ngrams(self, n: int, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words within one text, and the texts they are in."""
        h = self.hash if of is None else of
        m = len(h) - n + 1
        if m <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        run = h[:m].copy()
        for i in range(1, n):
            run = mixed(run * np.uint64(0xD6E8FEB86659FD93) + h[i:i + m])
        inside = self.doc[:m] == self.doc[n - 1:]
        return run[inside], self.doc[:m][inside]

    def shapes(self) -> np.ndarray:
        """Hash of each word's shape: its kinds of characters (small letter, capital, digit, each other sign), runs of
        a kind taken once."""
        kind = SHAPE[self.data]
        new = np.ones(len(kind), bool)
        new[1:] = kind[1:] != kind[:-1]
        new[self.start] = True
        rank = np.concatenate(([0], np.cumsum(new)))
        return self._hash(kind[new].astype(np.uint64) + np.uint64(1), rank[self.start], rank[self.end])


SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123] = SHAPE[128:] = 97
SHAPE[65:91] = 65
SHAPE[48:58] = 48


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of n words, letters A-Z lower-cased. A text of fewer words
    has its whole sequence as one; a text without words has none."""
    w = Words(texts, lower=True)
    runs, doc = w.ngrams(n)
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    for i in range(len(texts)):
        few = w.hash[w.first[i]:w.first[i + 1]]
        if 0 < len(few) < n:
            h = np.full(1, len(few), np.uint64)
            for x in few:
                h = mixed(h * np.uint64(0xD6E8FEB86659FD93) + x)
            out.append(h)
        else:
            out.append(np.unique(runs[at[i]:at[i + 1]]))
    return out
