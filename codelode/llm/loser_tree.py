"""A loser tree (tournament tree) over sorted runs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any


class LoserTree:
    """Merges k sorted runs of (key, value) in key order with one root-to-leaf replay per output.

    Inner nodes hold the run that lost the match played there; the overall winner is kept apart. Keys
    that compare equal come out in run order, so the merge is stable.
    """

    def __init__(self, runs: Iterable[Iterable[tuple[Any, Any]]]):
        self._runs = [iter(run) for run in runs]
        self._heads = [next(run, None) for run in self._runs]
        k = len(self._runs)
        self._losers = [-1] * k
        self._winner = self._build(1) if k else -1

    def _less(self, a: int, b: int) -> bool:
        x, y = self._heads[a], self._heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x[0] < y[0] or (x[0] == y[0] and a < b)

    def _build(self, node: int) -> int:
        k = len(self._runs)
        if node >= k:
            return node - k
        left, right = self._build(2 * node), self._build(2 * node + 1)
        won, lost = (left, right) if self._less(left, right) else (right, left)
        self._losers[node] = lost
        return won

    def __iter__(self) -> Iterator[tuple[Any, Any]]:
        k = len(self._runs)
        while self._winner >= 0 and (head := self._heads[self._winner]) is not None:
            yield head
            run = self._winner
            self._heads[run] = next(self._runs[run], None)
            node = (run + k) // 2
            while node >= 1:
                other = self._losers[node]
                if self._less(other, run):
                    self._losers[node], run = run, other
                node //= 2
            self._winner = run
