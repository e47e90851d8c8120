"""Suffix arrays of short byte strings ("pieces") in numpy, by Larsson-Sadakane refinement, and their common
prefixes by Kasai's algorithm."""

from __future__ import annotations

import numpy as np

#: Bytes that the first sort looks at; a further byte of its keys holds how many of them lie in the piece.
FIRST = 7


class Pieces:
    """Pieces of bytes behind one another; a suffix ends with its piece."""

    def __init__(self, pieces: list[bytes]):
        lengths = np.array([len(p) for p in pieces], np.int64)
        self.size = int(lengths.sum())
        self.ends = lengths.cumsum()
        self.starts = self.ends - lengths
        self.owner = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        self.bytes = np.frombuffer(b"".join(pieces) + bytes(16), np.uint8)
        #: The eight bytes from each place, the first one lowest.
        self.words = np.ndarray(self.size + 8, "<u8", self.bytes, strides=(1,))

    def left(self, places: np.ndarray) -> np.ndarray:
        """Bytes from each place to the end of its piece."""
        return self.ends[self.owner[places]] - places

    def suffix_array(self) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes in order, and the rank of each; equal suffixes are in the order of their places.

        Suffixes are sorted by their first bytes. Then all groups that are still equal are refined at once, by
        the rank of what follows, which doubles the depth each time; groups of one are left alone.
        """
        n, every = self.size, np.arange(self.size)
        left = self.left(every)
        within = np.minimum(left, FIRST)
        key = self.words[:n].byteswap() >> np.uint64(8)
        beyond = (8 * (FIRST - within)).astype(np.uint64)
        key = ((key >> beyond) << beyond) << np.uint64(8) | within.astype(np.uint64)
        order = np.argsort(key)
        rank = np.empty(n, np.int64)
        slots, rank[order] = self._groups(every, key[order])
        depth = FIRST
        while len(slots):
            places = order[slots]
            after = places + depth
            known = depth < left[places]
            if not known.any():
                break
            behind = np.where(known, rank[np.minimum(after, n - 1)] + 1, 0)
            key = rank[places] * (n + 1) + behind
            sorting = np.argsort(key)
            order[slots] = places = places[sorting]
            still, rank[places] = self._groups(slots, key[sorting])
            slots, depth = still, 2 * depth
        if len(slots):
            places = order[slots]
            order[slots] = places[np.lexsort((places, rank[places]))]
        rank[order] = every
        return order, rank

    @staticmethod
    def _groups(slots: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted keys: the slots whose key is not alone, and for each slot the first slot of its group."""
        if not len(keys):
            return slots, slots
        first = np.concatenate(([True], keys[1:] != keys[:-1]))
        heads = np.flatnonzero(first)
        sizes = np.diff(np.append(heads, len(keys)))
        return slots[np.repeat(sizes > 1, sizes)], np.repeat(slots[heads], sizes)

    def common_prefixes(self, order: np.ndarray, rank: np.ndarray, depth: int) -> np.ndarray:
        """For each slot of the suffix array the length of the prefix shared with the slot before, ``depth`` at most.

        Kasai's walk, over all pieces side by side: from a place to the next one the shared length falls by one
        at most. Places with fewer than ``depth`` bytes left are passed over.
        """
        shared = np.zeros(self.size, np.int16)
        place = self.starts[self.ends - self.starts >= depth]
        last = self.ends[self.ends - self.starts >= depth] - depth
        held = np.zeros(len(place), np.int64)
        while len(place):
            slot = rank[place]
            other = order[np.maximum(slot - 1, 0)]
            most = np.where(slot > 0, np.minimum(self.left(other), depth), 0)
            held = np.minimum(held, most)
            differ = self.words[place + held] ^ self.words[np.minimum(other + held, self.size - 1)]
            equal = np.bitwise_count((differ & -differ) - np.uint64(1)).astype(np.int64) >> 3
            held = np.minimum(held + equal, most)
            done = (equal < 8) | (held >= most)
            shared[slot[done]] = held[done]
            place = place + done
            held = np.where(done, np.maximum(held - 1, 0), held)
            going = place <= last
            if not going.all():
                place, last, held = place[going], last[going], held[going]
        return shared

    def repeated(self, depth: int) -> np.ndarray:
        """Places whose ``depth`` bytes also start at another place."""
        if not self.size:
            return np.empty(0, np.int64)
        order, rank = self.suffix_array()
        enough = self.common_prefixes(order, rank, depth) >= depth
        enough[:-1] |= enough[1:]
        return np.sort(order[enough])
