"""A minimal perfect hash over byte strings, by cascaded bit sets (after Limasset et al., 2017)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash

_MIX = np.uint64(0x9E3779B97F4A7C15)


def hashes(keys: Sequence[bytes]) -> np.ndarray:
    """64-bit hashes of the keys."""
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))


def _at(h: np.ndarray, level: int, size: int) -> np.ndarray:
    """The place of each hash on one level."""
    x = (h ^ np.uint64(level * 0x51_7C_C1_B7)) * _MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return (x % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Maps each of n different keys to its own number below n; other keys get a number or -1.

    On every level a key that is alone in its place sets a bit and stays; the others go on to the next
    level. A key's number is the rank of its bit. Whoever looks a key up has to compare it with the key
    stored under that number.
    """

    def __init__(self, keys: Sequence[bytes]):
        left = hashes(keys)
        if len(np.unique(left)) != len(keys):
            raise ValueError("keys must differ, also in their 64-bit hash")
        self._bits: list[np.ndarray] = []
        self._ranks: list[np.ndarray] = []
        total = 0
        while len(left):
            size = max(1, len(left))
            place = _at(left, len(self._bits), size)
            alone = np.bincount(place, minlength=size) == 1
            self._bits.append(alone)
            self._ranks.append(total + np.cumsum(alone) - 1)
            total += int(alone.sum())
            left = left[~alone[place]]

    def numbers(self, keys: Sequence[bytes]) -> np.ndarray:
        h = hashes(keys)
        found = np.full(len(h), -1, np.int64)
        todo = np.arange(len(h))
        for level, (bits, ranks) in enumerate(zip(self._bits, self._ranks)):
            place = _at(h[todo], level, len(bits))
            hit = bits[place]
            found[todo[hit]] = ranks[place[hit]]
            todo = todo[~hit]
        return found
