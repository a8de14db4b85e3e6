"""Problem 6: encoding a corpus with a public byte-level BPE vocabulary.

Method: texts are cut into pre-tokens; those that are vocabulary entries as a whole are resolved by a
minimal perfect hash, the rest by merging linked bytes with a heap of ranked neighbours. Both tiers work
on the different pre-tokens of an Arrow batch, and a bounded cache carries results between batches.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator, Sequence
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm.perfect_hash import PerfectHash
from codelode.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pre-token pattern of the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same over ASCII text, where the standard library's engine is faster.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_ANY = regex.compile(PATTERN)
#: Pre-tokens kept between batches, and the longest kept.
CACHE, CACHE_CHARS = 200_000, 64


class BytePairEncoder:
    """Encodes text as the vocabulary's ids; text that looks like a special token is ordinary text."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as lines:
            self._rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        keys = list(self._rank)
        self._hash = PerfectHash(keys)
        at = self._hash.numbers(keys)
        self._keys: list[bytes] = [b""] * len(keys)
        self._ids: list[int] = [0] * len(keys)
        for k, number in zip(keys, at.tolist()):
            self._keys[number], self._ids[number] = k, self._rank[k]
        self._cache: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def pre_tokens(text: str) -> list[str]:
        return (_ASCII if text.isascii() else _ANY).findall(text)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Second tier: merges the lowest-ranked neighbours first, the leftmost of equal rank."""
        rank, n = self._rank.get, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n))  # of a merged part, after is 0
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, end = heappop(heap)
            j = after[i]
            if not j or j >= n or after[j] != end:
                continue  # one of the two has been merged since
            after[i], after[j] = end, 0
            if end < n:
                before[end] = i
                if (r := rank(piece[i : after[end]])) is not None:
                    heappush(heap, (r, i, after[end]))
            if (h := before[i]) >= 0 and (r := rank(piece[h:end])) is not None:
                heappush(heap, (r, h, end))
        found, i = [], 0
        while i < n:
            found.append(self._rank[piece[i : after[i]]])
            i = after[i]
        return tuple(found)

    def resolve(self, pieces: Sequence[str]) -> list[tuple[int, ...]]:
        """First tier for all pieces at once, second tier for those it misses."""
        raw = [p.encode() for p in pieces]
        found = []
        for piece, number in zip(raw, self._hash.numbers(raw).tolist()):
            whole = number >= 0 and self._keys[number] == piece
            found.append((self._ids[number],) if whole else self.merge(piece))
        return found

    def encode_batch(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's ids end (with a leading 0)."""
        cut = [self.pre_tokens(t) if t else [] for t in texts]
        cache = self._cache
        new = [p for p in set().union(*cut) if p not in cache]
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = list(set().union(*cut))
        cache.update(zip(new, self.resolve(new)))
        ids, ends = [], [0]
        for pieces in cut:
            ids.extend(chain.from_iterable(map(cache.__getitem__, pieces)))
            ends.append(len(ids))
        for piece in new:
            if len(piece) > CACHE_CHARS:
                del cache[piece]
        return np.array(ids, np.int32), np.array(ends, np.int32)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()


_ENCODERS: dict[str, BytePairEncoder] = {}


_SHIPPED: set[tuple[str, str]] = set()


def ship_vocabulary(spark: SparkSession, path: str = VOCABULARY) -> None:
    """Gives every executor the vocabulary's file, once for each application."""
    this = (spark.sparkContext.applicationId, path)
    if this not in _SHIPPED:
        spark.sparkContext.addFile(path)
        _SHIPPED.add(this)


def encoder(path: str) -> BytePairEncoder:
    """One encoder per vocabulary in a worker process, from the path or else from the file that was shipped."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BytePairEncoder(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
    return _ENCODERS[path]


def _encoder(path: str, texts_at_once: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, texts_at_once):
                batch = whole.slice(at, texts_at_once)
                ids, ends = bpe.encode_batch(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=[batch.schema.names[0], "ids"])

    return encode


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, texts_at_once: int = 1000) -> DataFrame:
    """(key, ids array<int>) of every row of df, without special tokens; text is taken exactly as stored.

    Null and empty texts give an empty list; repeated rows stay; null keys stay null; other columns are
    never read. The vocabulary's file is read where the driver runs and shipped. No
    shuffle, but to spread a file in one piece over the cores.
    """
    ship_vocabulary(df.sparkSession, vocabulary)
    narrow = df.select(F.col(f"`{key}`"), F.col(f"`{text}`"))
    kind = narrow.schema[0].dataType.simpleString()
    return spread(narrow).mapInArrow(_encoder(vocabulary, texts_at_once), f"`{key}` {kind}, ids array<int>")
