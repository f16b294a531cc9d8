"""Words and word shingles of many texts as 64-bit hashes, by whole arrays.

Words are runs of bytes other than space and 0x09-0x0D, as everywhere in this package.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes that are hashed at once; a longer text is a block of its own.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MULTIPLIERS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_AS_IS = np.arange(1, 257, dtype=np.uint64)
_LOWER = _AS_IS.copy()
_LOWER[65:91] = _AS_IS[97:123]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread each of the uint64 values over all 64 bits; one-to-one."""
    h = (h ^ (h >> np.uint64(32))) * _MULTIPLIERS[0]
    h = (h ^ (h >> np.uint64(29))) * _MULTIPLIERS[1]
    return h ^ (h >> np.uint64(32))


class Hasher:
    """Hashes the words of texts: a polynomial of the bytes, from prefix sums, then mixed."""

    def __init__(self, lower: bool = False):
        self.table = _LOWER if lower else _AS_IS
        self.powers = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            step, back = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
            first = np.ones(1, np.uint64)
            self.powers = np.concatenate([first, np.multiply.accumulate(np.full(n - 1, step))])
            self.inverse = np.concatenate([first, np.multiply.accumulate(np.full(n - 1, back))])

    def blocks(self, texts: Sequence[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each block of `texts`: its first and its last index plus one, the words' hashes, in order, the bounds
        of each text in them (one more than texts), and the block's bytes, each text followed by a line feed."""
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last]) < BLOCK):
                size += len(texts[last]) + 1
                last += 1
            joined = np.frombuffer(b"\n".join(texts[first:last]) + b"\n", np.uint8)
            self._grow(max(BLOCK, len(joined)))
            space = _SPACE[joined]
            turn = np.flatnonzero(space[1:] != space[:-1]) + 1
            if not space[0]:
                turn = np.concatenate([[0], turn])
            starts, ends = turn[0::2], turn[1::2]
            sums = np.empty(len(joined) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(self.table[joined] * self.powers[: len(joined)], out=sums[1:])
            words = mix((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))
            text_ends = np.cumsum([len(text) + 1 for text in texts[first:last]])
            bounds = np.concatenate([[0], np.searchsorted(starts, text_ends)])
            yield first, last, words, bounds, joined
            first = last

    def shingles(self, texts: Sequence[bytes], width: int) -> Iterator[np.ndarray]:
        """The set of each text's word shingles, as sorted hashes.

        Fewer words than `width` are one shingle; no words, no shingle.
        """
        for first, last, words, bounds, _ in self.blocks(texts):
            runs = chain(words, width)
            for i in range(last - first):
                a, b = int(bounds[i]), int(bounds[i + 1])
                if b - a >= width:
                    yield np.unique(runs[a : b - width + 1])
                elif b > a:
                    yield chain(words[a:b], b - a)
                else:
                    yield np.zeros(0, np.uint64)


def chain(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of `width` words (runs that reach over a text's end included)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n] + np.uint64(width)
    for k in range(1, width):
        h = h * _MULTIPLIERS[2] + words[k : n + k]
        h ^= h >> np.uint64(31)
    return mix(h)
