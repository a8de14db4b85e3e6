"""Problem 7: passages of evaluation items inside a training corpus.

Method: a prefix-filtered set join. The sets are the five-word shingles of every window of ``least`` words
of a passage. Shingles are ordered by rarity in the whole corpus, and of each window only the rarest is
joined, since a document that holds the window holds that shingle too. A join partner has to leave
room for a window before and after it on both sides (length and positional bounds), and the words along
the alignment are compared until a whole window of the item is found.

The items are the stated query set: they are read in blocks of at most ``block_words`` words, so what is
sent to the executors has that bound however many items there are; every block is held against all
documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.look_alikes import fold_case

#: Words of a shingle.
SHINGLE = 5
_WORD = re.compile(r"[^\W_]+")
_ASCII_WORD = re.compile(r"[0-9a-z]+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Maximal runs of letters and digits, in one form for all spellings that look the same."""
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    return _WORD.findall(fold_case(text))


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in a row, and where each text begins (one more than texts)."""
    cut = [words_of(t) if t else [] for t in texts]
    begins = np.concatenate([[0], np.cumsum([len(c) for c in cut], dtype=np.int64)]).astype(np.int64)
    if not begins[-1]:
        return np.empty(0, np.uint64), begins
    column = pa.array([w for c in cut for w in c], pa.string()).dictionary_encode()
    unique = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in column.dictionary.to_pylist()), np.uint64, len(column.dictionary))
    return unique[column.indices.to_numpy()], begins


def shingles(words: np.ndarray) -> np.ndarray:
    """The hash of the SHINGLE words from each place on (places near the end are missing)."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    found = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        found = (found ^ words[k : k + n]) * _FACTOR
        found ^= found >> np.uint64(31)
    return found


@dataclass
class Items:
    """One block of items: their words in a row, and the places of every different shingle."""

    ids: list
    words: np.ndarray
    begins: np.ndarray
    keys: np.ndarray = field(init=False)
    places: np.ndarray = field(init=False)
    at: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        found = shingles(self.words)
        inside = np.zeros(len(self.words), bool)
        for a, b in zip(self.begins, self.begins[1:]):
            inside[a : max(a, b - SHINGLE + 1)] = True
        self.places = np.flatnonzero(inside[: len(found)])
        self.places = self.places[np.argsort(found[self.places], kind="stable")]
        self.keys, self.at = np.unique(found[self.places], return_index=True)
        self.at = np.append(self.at, len(self.places))

    def prefix(self, counts: dict[int, int], least: int) -> Items:
        """Only the rarest shingle of each window stays to be joined (ties: the smaller hash)."""
        hashed = shingles(self.words)
        rarity = {int(k): (counts.get(int(k), 0), int(k)) for k in self.keys}
        kept: set[int] = set()
        for a, b in zip(self.begins.tolist(), self.begins[1:].tolist()):
            for first in range(a, b - least + 1):
                kept.add(min((int(x) for x in hashed[first : first + least - SHINGLE + 1]), key=rarity.__getitem__))
        chosen = np.isin(self.keys, np.fromiter(kept, np.uint64, len(kept)))
        slim = object.__new__(Items)
        slim.ids, slim.words, slim.begins = self.ids, self.words, self.begins
        spans = [self.places[self.at[i] : self.at[i + 1]] for i in np.flatnonzero(chosen)]
        slim.keys = self.keys[chosen]
        slim.places = np.concatenate(spans) if spans else np.empty(0, np.int64)
        slim.at = np.concatenate([[0], np.cumsum([len(s) for s in spans])]).astype(np.int64)
        return slim

    def lookup(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in hashed that hold a key, and the number of the key."""
        if not len(self.keys) or not len(hashed):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashed), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == hashed)
        return hit, at[hit]


def _within(hashed_places: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text each place lies in, and whether its shingle ends inside that text."""
    text = np.searchsorted(begins, hashed_places, side="right") - 1
    return text, hashed_places + SHINGLE <= begins[text + 1]


def _counter(items) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = items.value
        total = np.zeros(len(held.keys), np.int64)
        for batch in batches:
            words, begins = word_hashes(batch.column(0).to_pylist())
            hit, key = held.lookup(shingles(words))
            _, whole = _within(hit, begins)
            np.add.at(total, key[whole], 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["key", "n"])

    return count


def matches(items: Items, words: np.ndarray, begins: np.ndarray, least: int) -> set[tuple[int, int]]:
    """(text, item) numbers where at least ``least`` words in a row agree."""
    hit, key = items.lookup(shingles(words))
    text, whole = _within(hit, begins)
    found: set[tuple[int, int]] = set()
    for d, t, k in zip(hit[whole].tolist(), text[whole].tolist(), key[whole].tolist()):
        for p in items.places[items.at[k] : items.at[k + 1]].tolist():
            item = int(np.searchsorted(items.begins, p, side="right")) - 1
            if (t, item) in found:
                continue
            back = min(d - begins[t], p - items.begins[item], least)
            ahead = min(begins[t + 1] - d, items.begins[item + 1] - p, least)
            if back + ahead < least:  # no window fits around this place
                continue
            same = words[d - back : d + ahead] == items.words[p - back : p + ahead]
            if same.all() or _longest(same) >= least:
                found.add((t, item))
    return found


def _longest(same: np.ndarray) -> int:
    breaks = np.flatnonzero(np.concatenate([[True], ~same, [True]]))
    return int(np.diff(breaks).max()) - 1


def _finder(items, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = items.value
        for batch in batches:
            words, begins = word_hashes(batch.column(1).to_pylist())
            found = sorted(matches(held, words, begins, least))
            rows = batch.column(0).take(pa.array([t for t, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([rows, pa.array([held.ids[i] for _, i in found], pa.int64())], names=["doc", "item"])

    return find


def leaked_items(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage", least: int = 12, block_words: int = 2_000_000) -> DataFrame:
    """(doc, item) for every document holding at least ``least`` consecutive words of an item's passage.

    Words are compared without regard to case, to what stands between them and to invisible differences.
    Passages of fewer than ``least`` words, null and empty passages and texts match nothing; rows with a
    null document or item id are left out; repeated rows count once; an item whose id comes with several
    passages leaks if any of them does. Other columns are never read; empty tables give an empty result.
    Item ids are integers.
    """
    if least < SHINGLE:
        raise ValueError(f"windows need at least {SHINGLE} words")
    spark = docs.sparkSession
    corpus = docs.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{text}`").alias("text")).where("doc is not null and text is not null")
    stated = items.select(F.col(f"`{item}`").cast("long").alias("item"), F.col(f"`{passage}`").alias("passage")).where("item is not null and passage is not null").distinct()
    size = stated.agg(F.sum(F.length("passage") + 1)).first()[0] or 0
    blocks = max(1, math.ceil(size / 2 / block_words))  # a word and what follows it take two characters or more
    kind = corpus.schema["doc"].dataType.simpleString()
    parts = []
    for k in range(blocks):
        rows = stated.where(F.pmod(F.xxhash64("item", "passage"), F.lit(blocks)) == k).orderBy("item", "passage").collect()
        words, begins = word_hashes([r.passage for r in rows])
        block = Items([r.item for r in rows], words, begins)
        counted = corpus.select("text").mapInArrow(_counter(spark.sparkContext.broadcast(block)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        counts = {int(block.keys[r.key]): r.n for r in counted.collect()}  # as many rows as the block has shingles, at most
        probe = spark.sparkContext.broadcast(block.prefix(counts, least))
        parts.append(corpus.mapInArrow(_finder(probe, least), f"doc {kind}, item long"))
    found = reduce(DataFrame.unionAll, parts).distinct()
    return found.select(F.col("doc").alias(doc), F.col("item").alias(item))
