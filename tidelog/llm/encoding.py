"""Shared parts of the tokenizing operators: texts as code points, and a bounded cache of encoded pieces of text."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tidelog.llm import text as tx


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of a chunk, the byte where each begins (n + 1), and row offsets in code points."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, np.append(lead, len(data)), np.searchsorted(lead, offsets)


class PieceCache:
    """Ids of pieces of text by 64-bit hash: a direct-mapped table over an append-only pool.

    Both are bounded: a piece that meets a taken slot replaces its owner, and the pool starts anew
    when it is full. Only pieces that are not in the table are encoded.
    """

    def __init__(self, encode: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], bits: int = 21, pool: int = 1 << 24):
        self.encode, self.mask, self.limit = encode, np.uint64((1 << bits) - 1), pool
        self.clear()

    def clear(self) -> None:
        """Forget everything; the memory goes back (pages of new zeros are not taken before they are used)."""
        n = int(self.mask) + 1
        self.keys = np.zeros(n, np.uint64)
        self.first, self.count = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.pool, self.used = np.zeros(self.limit, np.int32), 0

    def _append(self, ids: np.ndarray) -> int:
        if self.used + len(ids) > len(self.pool):  # the ids of one chunk beyond the limit
            self.pool = np.concatenate((self.pool[: self.used], np.zeros(len(ids) + self.limit // 4, np.int32)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other and the number of ids of each piece."""
        if self.used > self.limit // 2:
            self.clear()
        slot = (hashes & self.mask).astype(np.int64)
        known = self.keys[slot] == hashes
        first, count = self.first[slot], self.count[slot]
        missing = np.flatnonzero(~known)
        if len(missing):
            new, at, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            ids, counts = self.encode(missing[at], new)
            begin = self._append(ids) + np.cumsum(counts) - counts
            first[missing], count[missing] = begin[back], counts[back]
            slot = (new & self.mask).astype(np.int64)
            self.keys[slot], self.first[slot], self.count[slot] = new, begin, counts
        return self.pool[tx.ranges(first, count)], count


class HashIndex:
    """Position of 64-bit hashes in a fixed set of keys, -1 where absent: a table over the top bits of sorted keys."""

    def __init__(self, keys: np.ndarray, bits: int = 20):
        self.order = np.argsort(keys)
        self.keys = np.append(keys[self.order], np.uint64(0))
        self.shift = np.uint64(64 - bits)
        bounds = np.searchsorted(self.keys[:-1] >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64))
        self.first = bounds[:-1].astype(np.int32)
        self.deepest = int(np.diff(bounds).max(initial=0))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        at = self.first[(hashes >> self.shift).astype(np.int64)].astype(np.int64)
        out = np.full(len(hashes), -1, np.int64)
        for step in range(self.deepest):
            spot = np.minimum(at + step, len(self.order))
            hit = (self.keys[spot] == hashes) & (spot < len(self.order))
            out[hit] = self.order[spot[hit]]
        return out
