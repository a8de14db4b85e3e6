"""Folds over a chunk's lines that depend on all lines before: loop nesting and the brace-aware splitter."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.functions import text as X
from codelode.session import spread

# What opens a loop, by keyword or by call, and a condition; how functions are named; what sorts.
LOOPS = (r"\b(?:for|while|do)\s*[\s(]", r"\.(?:forEach|map|filter|reduce|flatMap|find|some|every)\s*\(")
LOOP = re.compile("|".join(LOOPS))
CONDITION = re.compile(r"\b(?:if|switch|else\s+if)\s*[\s(]")
NAMED = re.compile(r"function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:function|\(|\w+\s*=>)")
SORT = re.compile(r"\.sort\s*\(")


def nesting(lines: list[str], compat: bool = False) -> tuple[int, int, int]:
    """RUL3: (deepest loop nesting, lines with loops, lines with conditions).

    A loop ends with the brace that its line opens; one whose line opens none ends with the line. With
    ``compat`` (T8) a loop is remembered at the depth after its line instead, so that its own brace does
    not end it and loops in a row look nested.
    """
    depth, deepest, loops, conditions = 0, 0, 0, 0
    open_: list[int] = []
    for raw in lines:
        line = raw.strip()
        before, lowest = depth, depth
        for c in line:
            if c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                lowest = min(lowest, depth)
                if compat and open_ and open_[-1] == depth:
                    open_.pop()
        if not compat:
            while open_ and open_[-1] >= lowest:
                open_.pop()
        if LOOP.search(line):
            loops += 1
            deepest = max(deepest, len(open_) + 1)
            if compat:
                open_.append(depth)
            elif depth > min(before, lowest):
                open_.append(min(before, lowest))
        conditions += CONDITION.search(line) is not None
    return deepest, loops, conditions


def complexity_class(code: str, compat: bool = False) -> tuple[str, int, int, int, bool]:
    """RUL3-4: (class, deepest nesting, loops, conditions, recursion) of a function's code.

    T10: a function that is named like a call more than once recurses; more than twice counts as branching.
    """
    deepest, loops, conditions = nesting(code.split("\n"), compat)
    m = NAMED.search(code)
    name = m and (m[1] or m[2])
    calls = len(re.findall(rf"\b{re.escape(name)}\s*\(", code)) if name else 0
    recursive = calls > 1
    if recursive:
        found = "O(2^n)" if deepest >= 1 or calls > 2 else "O(n)"
    else:
        found = {0: "O(1)", 1: "O(n)", 2: "O(n²)"}.get(deepest, "O(n³)")
    if found in ("O(1)", "O(n)") and SORT.search(code):
        found = "O(n log n)"
    return found, deepest, loops, conditions, recursive


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [complexity_class(c) for c in batch.column(1).to_pylist()]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
        columns = [pa.array([m[k] for m in made], t) for k, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "class", "nesting", "loops", "conditions", "recursion"])


def complexity_classes(chunks: DataFrame) -> DataFrame:
    """RUL3: the estimate for every chunk with code, once for each id (columns id and code)."""
    given = spread(chunks.where("code is not null").select("id", "code"))
    return given.mapInArrow(_classify, "id string, class string, nesting int, loops int, conditions int, recursion boolean").distinct()


def windows(lines: list[str], most: int = 100) -> list[tuple[int, int]]:
    """PRS3: (first, last) of each part: it ends where ``most`` lines are reached at brace depth 1 or less, at the latest at half as many more, never at the last line.

    Depth starts at 0 in every part and doesn't fall below.
    """
    if len(lines) <= most:
        return [(0, len(lines) - 1)]
    found, start, depth = [], 0, 0
    for k, line in enumerate(lines[:-1]):
        for c in line:
            depth += c == "{"
            depth = max(0, depth - (c == "}"))
        size = k - start + 1
        if size >= most and (depth <= 1 or size >= most * 3 // 2):
            found.append((start, k))
            start, depth = k + 1, 0
    return [*found, (start, len(lines) - 1)]


def _splitter(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, code, start, complexity in zip(*(c.to_pylist() for c in batch.columns)):
                lines = code.split("\n")
                for n, (a, b) in enumerate(windows(lines, most), 1):
                    share = max(1, int(complexity * (b - a + 1) / len(lines) + 0.5))
                    rows.append((key, n, start + a, start + b, share, "\n".join(lines[a : b + 1])))
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["id", "part", "first_line", "last_line", "complexity", "code"])

    return split


def split_chunks(chunks: DataFrame, most: int = 100) -> DataFrame:
    """PRS3, WIN10: (id, part, first_line, last_line, complexity, code, part_id) of the chunks of more than ``most`` lines.

    Complexity is shared by lines, at least 1 each; a part's id is that of a chunk with its path, line and
    code. Null start lines count as 1, null complexity as 1.
    """
    code = F.col("code")
    long = chunks.where(F.length(code) - F.length(F.replace(code, F.lit("\n"))) + 1 > most)
    once = long.groupBy("id").agg(F.max("code").alias("code"), F.max(F.coalesce("start_line", F.lit(1))).alias("s"), F.max(F.coalesce("cyclomatic_complexity", F.lit(1))).alias("c"), F.max("file_path").alias("file_path"))
    parts = once.select("id", "code", "s", "c").mapInArrow(_splitter(most), "id string, part int, first_line int, last_line int, complexity int, code string")
    return parts.join(once.select("id", "file_path"), "id").withColumn("part_id", X.chunk_id(F.col("file_path"), F.col("first_line"), F.col("code")))
