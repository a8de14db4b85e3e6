"""Problem 1: the top n items of every group by merging sorted runs.

Method: every input partition is sorted by (group, score) in the JVM and read as one run, from which at
most n items of a group are taken before seeking to the next group. The runs are exchanged by the
group's hash bucket, ordered by (group, run, score) inside it, and merged group by group with a loser
tree that stops after n different items. Above ``fan_in`` runs the merge takes several passes, all but
the last over (group, block of runs), until ``fan_in`` blocks are left, so that no task meets more than
``fan_in * n`` rows of a group however large the group is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.llm.loser_tree import LoserTree

#: Runs merged at once.
FAN_IN = 512


def _starts(groups: pa.Array) -> list[int]:
    """Where a new value begins in a sorted array without nulls."""
    if len(groups) < 2:
        return [0]
    return [0, *(i + 1 for i in pc.indices_nonzero(pc.not_equal(groups[1:], groups[:-1])).to_pylist())]


def _run_former(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Takes the first n different items of each group of one sorted run."""

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId()
        group, seen = None, set()
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _starts(batch.column(0))
            items, keys = batch.column(3), batch.column(0).take(pa.array(starts)).to_pylist()
            kept: list[int] = []
            for k, start in enumerate(starts):
                if keys[k] != group:
                    group, seen = keys[k], set()
                end = starts[k + 1] if k + 1 < len(starts) else batch.num_rows
                at = start
                while at < end and len(seen) < n:  # beyond n: seek to the next group
                    item = items[at].as_py()
                    if item not in seen:
                        seen.add(item)
                        kept.append(at)
                    at += 1
            taken = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array([run] * len(kept), pa.int32())], names=["g", "s", "t", "i", "run"])

    return form


def _merger(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Merges the runs of each group; rows come ordered by (group, run, score)."""

    def best(rows: list[tuple]) -> list[tuple]:
        runs: dict[int, list] = {}
        for row in rows:
            key = (-row[1], row[2] is None, row[2] if row[2] is not None else 0, row[3])
            runs.setdefault(row[4], []).append((key, row))
        found: list[tuple] = []
        seen: set = set()
        for _, row in LoserTree(runs.values()):
            if row[3] not in seen:
                seen.add(row[3])
                found.append(row)
                if len(found) == n:
                    break
        return found

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, open_rows, out = None, [], []
        for batch in batches:
            schema = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if open_rows and row[0] != open_rows[0][0]:
                    out += best(open_rows)
                    open_rows = []
                open_rows.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if open_rows:
            out = best(open_rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return merge


def top_n_per_group(df: DataFrame, group: str, score: str, item: str, n: int, tie: str, fan_in: int = FAN_IN) -> DataFrame:
    """The n best different items of every group, as columns (group, item).

    An item counts once in a group, with its highest score. Order: score descending, ``tie`` ascending
    with nulls last, item ascending. Rows whose group, score or item is null are left out, so a group
    without any score has no rows; an empty table gives an empty result. Other columns of df, whatever
    their names, are never read. An item may be in several groups.
    """
    if n < 1 or fan_in < 2:
        raise ValueError("n must be at least 1 and fan_in at least 2")
    col: Callable[[str], Column] = lambda name: F.col(f"`{name}`")
    narrow = df.select(col(group).alias("g"), col(score).alias("s"), col(tie).alias("t"), col(item).alias("i"))
    narrow = narrow.where("g is not null and s is not null and i is not null")
    order = [F.col("s").desc(), F.col("t").asc_nulls_last(), F.col("i").asc()]
    types = {f.name: f.dataType.simpleString() for f in narrow.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in "gsti") + ", run int"
    sorted_runs = narrow.sortWithinPartitions("g", *order)
    runs = sorted_runs.mapInArrow(_run_former(n), schema)
    n_runs = narrow._jdf.queryExecution().toRdd().getNumPartitions()
    while n_runs > fan_in:
        block = F.expr(f"run div {fan_in}")
        passed = runs.withColumn("block", block).repartition("g", "block").sortWithinPartitions("block", "g", "run", *order)
        runs = passed.drop("block").mapInArrow(_merger(n), schema).withColumn("run", block.cast("int"))
        n_runs = math.ceil(n_runs / fan_in)
    merged = runs.repartition("g").sortWithinPartitions("g", "run", *order).mapInArrow(_merger(n), schema)
    return merged.select(F.col("g").alias(group), F.col("i").alias(item))
