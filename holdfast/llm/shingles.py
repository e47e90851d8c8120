"""Word shingles of many texts at once, as 64-bit hashes.

Words are runs of bytes other than blank and ``\\t`` to ``\\r``, with A-Z in lower case. A shingle is
``width`` words in a row; a text with fewer words is one shingle, a text without words has none.
"""

from __future__ import annotations

import numpy as np

#: Texts longer than this are hashed in blocks that end at white space.
BLOCK = 1 << 18
_STEP, _START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    def __init__(self, width: int = 5):
        self.width = width
        value = _table()
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self.lower = np.arange(256, dtype=np.uint64)
        self.lower[65:91] += np.uint64(32)
        self.weight = value[256 : 256 + width] | np.uint64(1)
        self.short = value[300 : 300 + width] | np.uint64(1)

    def _block(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and start of every word of a run of bytes.

        Each byte is mixed with its place in the word before the sum, so no two words have equal sums by their
        pattern, as they can have in a polynomial modulo a power of two.
        """
        word = ~self.space[block]
        edges = np.diff(np.concatenate(([False], word, [False])).astype(np.int8))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        if not len(starts):
            return np.empty(0, np.uint64), starts
        lengths = ends - starts
        heads = lengths.cumsum() - lengths
        place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(heads, lengths)
        mixed = mix((place.astype(np.uint64) << np.uint64(8) | self.lower[block[word]]) * _STEP + _START)
        return mix(np.add.reduceat(mixed, heads) + lengths.astype(np.uint64)), starts

    def words(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        block, hashes, starts, at = np.frombuffer(text, np.uint8), [], [], 0
        while at < len(block):
            end = min(at + BLOCK, len(block))
            while end < len(block) and not self.space[block[end]]:
                end += 1
            found, where = self._block(block[at:end])
            hashes.append(found)
            starts.append(where + at)
            at = end
        if not hashes:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        return np.concatenate(hashes), np.concatenate(starts)

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """Sorted distinct shingles of each text."""
        hashes, starts = self.words(b"\n".join(texts))
        ends = np.cumsum([len(t) + 1 for t in texts])
        bounds = [0, *np.searchsorted(starts, ends).tolist()]
        width, n = self.width, len(hashes)
        if n >= width:
            grams = sum((hashes[k : n - width + 1 + k] * w for k, w in enumerate(self.weight)), np.uint64(0))
            grams = mix(grams)
        result = []
        for a, b in zip(bounds, bounds[1:]):
            if b - a >= width:
                result.append(np.unique(grams[a : b - width + 1]))
            elif b > a:
                few = (hashes[a:b] * self.short[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                result.append(mix(np.array([few], np.uint64)))
            else:
                result.append(np.empty(0, np.uint64))
        return result


def _table() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240611)).integers(0, 1 << 64, 512, np.uint64, endpoint=False)


def fingerprint(shingles: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    one, two = mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), mix(shingles + np.uint64(0x14057B7EF767814F))
    return np.array([one.sum(dtype=np.uint64), two.sum(dtype=np.uint64)], np.uint64).tobytes()


class MinHasher:
    """Minima of many universal hash functions ``a * x + b`` modulo 2**32, ``a`` odd."""

    def __init__(self, functions: int):
        draw = np.random.Generator(np.random.PCG64(7919))
        self.a = draw.integers(0, 1 << 32, functions, np.uint32, endpoint=False) | np.uint32(1)
        self.b = draw.integers(0, 1 << 32, functions, np.uint32, endpoint=False)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row per set; no set may be empty."""
        x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
        result = np.empty((len(sets), len(self.a)), np.uint32)
        hashed = np.empty_like(x)
        for k in range(len(self.a)):
            np.multiply(x, self.a[k], out=hashed)
            np.add(hashed, self.b[k], out=hashed)
            result[:, k] = np.minimum.reduceat(hashed, starts)
        return result
