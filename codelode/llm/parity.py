"""Sets of token runs and their parity sketches, for whole batches of texts at once."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

_TOKEN = re.compile(rb"[A-Za-z0-9_]+")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A permutation of 64-bit numbers, another one for every salt."""
    x = (x ^ np.uint64(salt * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)) * _A
    x ^= x >> np.uint64(29)
    x *= _B
    x ^= x >> np.uint64(32)
    return x


def tokens_of(text: str) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and underscores, in lower case."""
    return _TOKEN.findall(text.encode().lower())


def parity_bits(elements: np.ndarray, owner: np.ndarray, sets: int, words: int) -> np.ndarray:
    """For each of so many sets, 64 * words bits of how often (mod 2) its elements hit them."""
    place = mixed(elements, 9) % np.uint64(64 * words)
    cell = owner.astype(np.int64) * (64 * words) + place.astype(np.int64)
    odd = np.unique(cell, return_counts=True)
    cell = odd[0][odd[1] % 2 == 1]
    found = np.zeros(sets * words, np.uint64)
    if len(cell):
        word = cell >> 6
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        found[word[first]] = np.bitwise_or.reduceat(np.uint64(1) << (cell & 63).astype(np.uint64), first)
    return found.reshape(sets, words)


@dataclass
class Sets:
    """The sets of a batch: element hashes in a row, sorted in each set, and where each set begins."""

    elements: np.ndarray
    begins: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.begins)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.begins) - 1), self.sizes)

    def only(self, which: np.ndarray) -> Sets:
        """The chosen sets, in that order."""
        size = self.sizes[which]
        begins = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        return Sets(self.elements[np.arange(begins[-1]) - np.repeat(begins[:-1] - self.begins[which], size)], begins)

    def fingerprints(self, salt: int = 0) -> np.ndarray:
        """One hash for each set, equal for equal sets, another one for every salt; 0 for the empty set."""
        total = np.zeros(len(self.begins) - 1, np.uint64)
        some = np.flatnonzero(self.sizes)
        if len(some):
            total[some] = np.add.reduceat(mixed(self.elements, 7 + 100 * salt), self.begins[some])
        return mixed(total, 8 + 100 * salt) * (self.sizes > 0).astype(np.uint64)

    def sketches(self, words: int) -> np.ndarray:
        """A parity sketch of 64 * words bits for each set: a bit holds whether it was hit an odd number of times.

        The Hamming distance of two sketches is at most the size of the sets' symmetric difference.
        """
        return parity_bits(self.elements, self.owner, len(self.begins) - 1, words)

    def part_keys(self, which: np.ndarray, parts: int, salt: int) -> Parts:
        """The parts that are not empty of the chosen sets.

        Elements are dealt to parts by their hash; a part's key is the XOR of its elements' hashes (the
        parity sketch of that part, over as many bits as there are hashes) with the part's number. With
        parts = 0 every element is a part of its own.
        """
        owner, elements = self.owner, self.elements
        chosen = which[owner]
        owner, elements = owner[chosen], elements[chosen]
        if not parts or not len(owner):
            return Parts(owner, elements, mixed(elements, salt))
        part = mixed(elements, salt) % np.uint64(parts)
        cell = owner.astype(np.uint64) * np.uint64(parts) + part
        order = np.argsort(cell, kind="stable")
        cell, part = cell[order], part[order]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        key = np.bitwise_xor.reduceat(mixed(elements[order], salt + 1), first)
        return Parts(owner[order][first], part[first], mixed(key ^ mixed(part[first], salt + 2), salt + 3))

    def parts_hit(self, which: np.ndarray, parts: int, salt: int) -> np.ndarray:
        """How many parts of each chosen set are not empty, dealt as in ``part_keys``."""
        if not parts:
            return self.sizes[which]
        chosen = which[self.owner]
        row = np.cumsum(which) - 1
        hit = np.zeros((int(which.sum()), parts), bool)
        hit[row[self.owner[chosen]], (mixed(self.elements[chosen], salt) % np.uint64(parts)).astype(np.int64)] = True
        return hit.sum(axis=1)

    def without(self, owner: np.ndarray, part: np.ndarray, parts: int, salt: int) -> Sets:
        """For each (set, part): the set without that part's elements."""
        size = self.sizes[owner]
        begins = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(begins[-1]) - np.repeat(begins[:-1] - self.begins[owner], size)
        elements = self.elements[at]
        dealt = mixed(elements, salt) % np.uint64(parts) if parts else elements
        rest = dealt != np.repeat(part, size)
        left = np.bincount(np.repeat(np.arange(len(owner)), size)[rest], minlength=len(owner))
        return Sets(elements[rest], np.concatenate([[0], np.cumsum(left)]).astype(np.int64))


@dataclass
class Parts:
    """Parts of sets: the set's number, the part's number and its key."""

    owner: np.ndarray
    part: np.ndarray
    key: np.ndarray


def sets_of(texts: Sequence[str], run: int, least: int) -> Sets:
    """The sets of all runs of ``run`` consecutive tokens; texts of fewer than ``least`` tokens get empty sets."""
    cut = [tokens_of(t) if t else [] for t in texts]
    counts = np.array([len(c) if len(c) >= max(least, run) else 0 for c in cut], np.int64)
    flat = [t for c, n in zip(cut, counts) if n for t in c]
    if not flat:
        return Sets(np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64))
    column = pa.array(flat, pa.binary()).dictionary_encode()
    unique = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in column.dictionary.to_pylist()), np.uint64, len(column.dictionary))
    hashed = unique[column.indices.to_numpy()]
    begins = np.concatenate([[0], np.cumsum(counts)])
    n = len(hashed) - run + 1
    runs = np.zeros(n, np.uint64)
    for k in range(run):
        runs = mixed(runs ^ hashed[k : k + n], k + 11)
    owner = np.repeat(np.arange(len(texts)), counts)
    whole = owner[:n] == owner[run - 1 :]
    owner, runs = owner[:n][whole], runs[whole]
    order = np.lexsort((runs, owner))
    owner, runs = owner[order], runs[order]
    new = np.concatenate([[True], (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])])
    owner, runs = owner[new], runs[new]
    return Sets(runs, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).astype(np.int64))
