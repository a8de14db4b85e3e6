"""Problem 3: cutting oversized items at natural boundaries, by agglomerative merging.

Method: the atomic segments of an item are its lines, linked in order. Pairs of neighbours are held in a
heap by the strength of the boundary between them; the weakest is merged first while the combined size
plus the overlap that the piece repeats fits the limit, and is refused for good where it does not. Cuts
are either anchored (a piece's boundaries are judged by their place from its start on, which fixes the
pieces one after the other) or made over the whole item at once. Items within the limit never leave the JVM.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Sizes in lines: at most ``most`` in a piece, no natural cut before ``least``, ``overlap`` repeated."""

    most: int = 100
    least: int = 60
    overlap: int = 5

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.least <= self.most:
            raise ValueError("0 <= overlap < least <= most must hold")


def lines_of(text: str) -> list[str]:
    """Lines separated by ``\\n``; one at the very end starts no further line."""
    lines = text.split("\n")
    return lines[:-1] if len(lines) > 1 and lines[-1] == "" else lines


def boundary(line: str) -> int:
    """How natural a cut after this line is: 2 blank, 1 closing brace, 0 any other."""
    bare = line.strip()
    return 2 if not bare else int(bare[0] == "}")


def agglomerate(sizes: Sequence[int], strengths: Sequence[tuple], most: int, overlap: int = 0, first: bool = True) -> list[int]:
    """The last atom of each segment after merging neighbours across the weakest boundaries first.

    ``strengths[k]`` is that of the boundary after atom k. A segment's size is that of its atoms and the
    ``overlap`` that it repeats from the one before; the leading segment repeats none if it is an item's
    ``first``. Two neighbours are merged only while their combined size fits ``most``, so a boundary that
    is refused stays. Boundaries of equal strength are merged where the outcome is smallest, the leftmost
    of those first. An atom that is larger than the limit by itself is left alone.
    """
    n = len(sizes)
    total, after, before = list(sizes), list(range(1, n + 1)), list(range(-1, n - 1))  # of a segment, by its first atom
    merged = [False] * n

    def pair(left: int) -> tuple:
        right = after[left]
        return strengths[right - 1], total[left] + total[right], left, right

    heap = [pair(k) for k in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, left, right = heapq.heappop(heap)
        if merged[left] or merged[right] or after[left] != right or size != total[left] + total[right]:
            continue  # one of the two has grown or is gone
        if size + (0 if left == 0 and first else overlap) > most:
            continue  # neither will ever be smaller
        merged[right], total[left], after[left] = True, size, after[right]
        if after[left] < n:
            before[after[left]] = left
            heapq.heappush(heap, pair(left))
        if left:
            heapq.heappush(heap, pair(before[left]))
    return [after[k] - 1 for k in range(n) if not merged[k]]


def pieces(lines: Sequence[str], limits: Limits) -> list[tuple[int, int]]:
    """0-based (first, last) line of each piece; one piece when the lines fit the limit.

    Lines are merged from the piece's start on, as many as may fill it and one more, so that one boundary
    has to stay. Those too early for a cut are the weakest, then they go by kind and place.
    """
    found, start, repeated = [], 0, 0
    while len(lines) - start > limits.most:
        fresh = start + repeated
        window = range(fresh, start + limits.most + 1)
        strengths = [(0 if k - start + 1 < limits.least else 1 + boundary(lines[k]), k) for k in window]
        end = fresh + agglomerate([1] * len(window), strengths, limits.most, limits.overlap, first=not found)[0]
        found.append((start, end))
        start, repeated = end + 1 - limits.overlap, limits.overlap
    found.append((start, len(lines) - 1))
    return found


def merged_pieces(lines: Sequence[str], limits: Limits) -> list[tuple[int, int]]:
    """0-based (first, last) line of each piece when the boundaries of the whole item compete at once.

    ``limits.least`` has no part in it: pieces are as small as their natural boundaries make them.
    """
    ends = agglomerate([1] * len(lines), [(boundary(x),) for x in lines], limits.most, limits.overlap)
    return [(max(0, a + 1 - limits.overlap), b) for a, b in zip([-1, *ends], ends)]


def _splitter(limits: Limits, cuts: Callable[[Sequence[str], Limits], list[tuple[int, int]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, firsts, lasts = [], [], [], []
            for key, code, start in zip(*(c.to_pylist() for c in batch.columns)):
                for k, (a, b) in enumerate(cuts(lines_of(code), limits), 1):
                    ids.append(key)
                    numbers.append(k)
                    firsts.append(start + a)
                    lasts.append(start + b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), *(pa.array(x, pa.int32()) for x in (numbers, firsts, lasts))], names=["id", "piece_no", "first_line", "last_line"])

    return split


def split_oversized(df: DataFrame, item: str = "id", text: str = "code", start: str = "start_line", limits: Limits | None = None, anchored: bool = True) -> DataFrame:
    """All pieces of every text of more than ``limits.most`` lines: (id, piece_no, first_line, last_line).

    ``anchored`` cuts as ``pieces``, else as ``merged_pieces``. Lines are numbered from ``start`` on, from 1
    where it is null. Null and empty texts and those within
    the limit give no rows; a null item keeps its pieces under a null id. Repeated rows give their pieces
    once. Other columns of df are never read; an empty table gives an empty result.
    """
    limits = limits or Limits()
    code = F.col(f"`{text}`")
    count = F.length(code) - F.length(F.replace(code, F.lit("\n"))) + 1 - F.when(code.endswith("\n"), 1).otherwise(0)
    long = df.where(count > limits.most).select(F.col(f"`{item}`").alias("id"), code.alias("code"), F.coalesce(F.col(f"`{start}`"), F.lit(1)).cast("int").alias("start"))
    kind = long.schema["id"].dataType.simpleString()
    cut = long.mapInArrow(_splitter(limits, pieces if anchored else merged_pieces), f"id {kind}, piece_no int, first_line int, last_line int")
    return cut.distinct()
