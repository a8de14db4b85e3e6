"""Exact cosine search: a stated set of queries, in blocks, against all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that are sent to the executors at once.
QUERIES_AT_ONCE = 4096
#: Queries that meet a batch of rows at once, which bounds a worker's memory.
TILE = 256


def _searcher(sent, k: int, threshold: float, tile: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
            for numbers, matrix in sent.value:
                size = matrix.shape[1]
                whole = np.flatnonzero(np.diff(offsets) == size)
                rows = values[offsets[whole][:, None] + np.arange(size)]
                usable = np.isfinite(rows).all(axis=1) & (np.abs(rows).sum(axis=1) > 0)
                whole, rows = whole[usable], rows[usable]
                if not len(whole):
                    continue
                rows = (rows / np.linalg.norm(rows, axis=1)[:, None]).T
                for at in range(0, len(matrix), tile):
                    similar = matrix[at : at + tile] @ rows
                    # ties at the k-th place all stay; the last step orders them
                    kth = np.partition(similar, -k, axis=1)[:, -k] if similar.shape[1] > k else np.full(len(similar), -np.inf)
                    q, r = np.nonzero((similar >= kth[:, None] - 1e-9) & (similar >= threshold - 1e-9))
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[at + q]), batch.column(0).take(pa.array(whole[r])), pa.array(similar[q, r])], names=["query", "id", "similarity"])

    return search


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, threshold: float = 0.3, at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """GRV6: (query, id, similarity, place): the k rows most similar to each query, at least ``threshold``.

    Both sides are (id, embedding). Queries are the stated set: they are dealt into blocks of about
    ``at_once`` that are sent to the executors in turn, each of which meets every row once and keeps k
    rows of a partition before anything is exchanged. Vectors meet those of their own length only;
    null, not finite and zero ones match nothing. Similarity is rounded to six places; ties go to the smaller id.
    """
    spark = rows.sparkSession
    asked = queries.where("embedding is not null").dropDuplicates(["id"])
    n = asked.count()
    kind = rows.schema["id"].dataType.simpleString()
    found: DataFrame | None = None
    blocks = max(1, -(-n // at_once))
    given = rows.where("embedding is not null").select("id", "embedding")
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("id", "embedding").toPandas()
        if not len(block):
            continue
        groups = []
        for _, same in block.groupby(block["embedding"].map(len)):
            matrix = np.stack(same["embedding"].map(lambda v: np.asarray(v, np.float64)).to_list())
            norm = np.linalg.norm(matrix, axis=1)
            good = np.isfinite(norm) & (norm > 0)
            groups.append((same["id"].to_numpy()[good], matrix[good] / norm[good][:, None]))
        sent = spark.sparkContext.broadcast(groups)
        part = given.mapInArrow(_searcher(sent, k, threshold, TILE), f"query {kind}, id {kind}, similarity double")
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = spark.createDataFrame([], f"query {kind}, id {kind}, similarity double")
    rounded = found.select("query", "id", F.round("similarity", 6).alias("similarity")).where(F.col("similarity") >= threshold).distinct()
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("similarity").desc(), "id"))
    return rounded.withColumn("place", place).where(F.col("place") <= k).withColumn("place", F.col("place").cast("long"))


def rank(primary: DataFrame, neighbours: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """WIN2: (id, kind, score): matches by place, neighbours by complexity, both a little more with smells.

    primary: id, place (from 1), smelly; neighbours: id, complexity, smelly; both with the columns ``by``,
    whose values are ranked apart.
    """
    bonus = F.when(F.col("smelly"), 0.1).otherwise(0.0)
    count = F.count("*").over(Window.partitionBy(*(by or (F.lit(1),))))  # over the k matches
    a = primary.select(*by, "id", F.lit("primary").alias("kind"), F.round(1.0 - (F.col("place") - 1) / count + bonus, 6).alias("score"))
    b = neighbours.select(*by, "id", F.lit("neighbour"), F.round(0.5 + F.least(F.coalesce("complexity", F.lit(0)) / 20, F.lit(0.3)) + bonus, 6))
    return a.unionAll(b)
