"""The property graph of chunks, files and repositories: derived, kept in step, and asked by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.operators import diffing, graph


@dataclass
class PropertyGraph:
    """SNK6-7: vertices and edges as tables; keys are unique because every table is made distinct."""

    files: DataFrame
    chunks: DataFrame
    contains: DataFrame
    imports: DataFrame


def property_graph(chunks: DataFrame, edge: DataFrame) -> PropertyGraph:
    """SNK7: files come from chunks and from both ends of imports; a chunk belongs to its file.

    chunks has one row for each id. Writing the same tables again changes nothing.
    """
    ends = edge.select(F.col("src").alias("path")).unionAll(edge.select("dst"))
    files = chunks.where("file_path is not null").select(F.col("file_path").alias("path")).unionAll(ends).distinct()
    contains = chunks.where("file_path is not null").select(F.col("file_path").alias("path"), F.col("id").alias("chunk")).distinct()
    return PropertyGraph(files, chunks, contains, edge)


def without_chunks(g: PropertyGraph, gone: DataFrame) -> PropertyGraph:
    """SNK8: the graph without some chunks (column id) and the edges to them."""
    ids = gone.select("id").distinct()
    return PropertyGraph(g.files, g.chunks.join(ids, "id", "left_anti"), g.contains.join(ids.withColumnRenamed("id", "chunk"), "chunk", "left_anti").select("path", "chunk"), g.imports)


def stored_chunks(vectors: DataFrame) -> DataFrame:
    """SCL13: stored payloads as chunks, one for each id, with what only chunks have left null (T4)."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    once = vectors.where("chunk_id is not null").dropDuplicates(["chunk_id"])
    return once.select(
        F.col("chunk_id").alias("id"), "code", "file_path", "start_line", "end_line", none("array<string>", "imports"), none("array<string>", "resolved_deps"), "cyclomatic_complexity", "halstead_volume",
        none("array<struct<type: string, message: string, line: int>>", "smells"),
    )


# Parts of paths that call for a security review.
SENSITIVE = "auth|login|session|token|secret|password|crypto|sql|query|db|middleware"


def plan(chunks: DataFrame, most: int = 10, top: int = 30) -> DataFrame:
    """RUL10-11: (agent, chunk, place) among the ``top`` most complex chunks: smelly ones and those of sensitive paths for security, complex ones for performance; an agent without any gets the ``most`` most complex.

    chunks: id, file_path, cyclomatic_complexity, smells, one row for each id. Ties go to the smaller id.
    """
    by_complexity = (F.col("cyclomatic_complexity").desc_nulls_last(), F.col("id"))
    first = chunks.select("id", "file_path", "cyclomatic_complexity", F.coalesce(F.size("smells"), F.lit(0)).alias("smelly")).orderBy(*by_complexity).limit(top)
    order = Window.partitionBy("agent").orderBy(*by_complexity)
    agents = F.array_compact(F.array(F.when((F.col("smelly") > 0) | F.lower("file_path").rlike(SENSITIVE), "security"), F.when(F.col("cyclomatic_complexity") >= 5, "performance")))
    chosen = first.select("id", "cyclomatic_complexity", F.explode(agents).alias("agent"))
    spare = first.orderBy(*by_complexity).limit(most).select("id", "cyclomatic_complexity", F.explode(F.array(F.lit("security"), F.lit("performance"))).alias("agent"))
    fallback = spare.join(chosen.select("agent").distinct(), "agent", "left_anti").select("id", "cyclomatic_complexity", "agent")
    return chosen.unionAll(fallback).select("agent", F.col("id").alias("chunk"), F.row_number().over(order).cast("long").alias("place"))


def tests_wanted(files: DataFrame) -> DataFrame:
    """RUL10: (tests): whether any path (column path) is a test's, which calls for the coverage agent."""
    path = F.lower("path")
    return files.agg(F.coalesce(F.bool_or(path.contains(".test.") | path.contains(".spec.") | path.contains("__tests__")), F.lit(False)).alias("tests"))


def sync(stored: DataFrame, current: DataFrame, key: str = "id", value: str = "hash") -> tuple[DataFrame, DataFrame]:
    """GRV8: (the rows to store from now on, the changes): new and updated rows replace, deleted ones go.

    Both have key, value and the same other columns; unchanged rows stay as stored, so that what was
    computed for them (their vectors) is not computed again.
    """
    changes = diffing.diff(current, stored, key, value)
    touched = current.join(changes.where("change in ('new', 'updated')").select(key), key, "left_semi")
    return diffing.upsert(stored, touched, key, changes.where("change = 'deleted'")), changes


def context(chunks: DataFrame, edge: DataFrame, wanted: DataFrame, depth: int = 2, most: int = 20) -> DataFrame:
    """JOI18: (id, neighbour, place, neighbours) of each wanted chunk: up to ``most`` chunks of files near its own.

    ``neighbours`` is the number before the cut. Order is by id. Of each file only its first ``most``
    chunks and their number are joined, so one very large file doesn't multiply.
    """
    around = edge.select(F.col("src").alias("file"), F.col("dst").alias("next")).unionAll(edge.select("dst", "src")).distinct()
    reach = wanted.select("id").join(chunks.select("id", F.col("file_path").alias("file")), "id").select("id", "file").distinct()
    seen = reach
    for _ in range(depth):
        step = seen.join(around, "file").select("id", F.col("next").alias("file"))
        seen = seen.unionAll(step).distinct()
    near = seen.join(reach, ["id", "file"], "left_anti")
    of_file = chunks.select(F.col("id").alias("neighbour"), F.col("file_path").alias("file"))
    first = of_file.withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("neighbour"))).where(F.col("k") <= most).drop("k")
    total = near.join(of_file.groupBy("file").agg(F.count("*").alias("n")), "file").groupBy("id").agg(F.sum("n").alias("neighbours"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("neighbour"))
    rows = near.join(first, "file").select("id", "neighbour", place.alias("place")).where(F.col("place") <= most)
    return rows.join(total, "id").select("id", "neighbour", F.col("place").cast("long").alias("place"), "neighbours")


class KnowledgeGraph:
    """GRV12: canned queries by name over the full tables, without caps on what they read (T4, T5)."""

    def __init__(self, chunks: DataFrame, edge: DataFrame):
        self._chunks, self._edge = chunks, edge
        self._named: dict[str, Callable[[], DataFrame]] = {
            "high_complexity_chunks": lambda: self._ranked(self._chunks.where("cyclomatic_complexity is not null").select("id", "file_path", F.col("cyclomatic_complexity").alias("n")), "id"),
            "most_imported_files": lambda: self._ranked(self._edge.groupBy(F.col("dst").alias("file_path")).agg(F.count("*").alias("n")), "file_path"),
            "files_with_smells": lambda: self._ranked(self._chunks.where("size(smells) > 0").groupBy("file_path").agg(F.sum(F.size("smells")).alias("n")), "file_path"),
            "dependency_fan_out": lambda: self._ranked(graph.degrees(self._edge).where("fan_out > 0").select(F.col("file").alias("file_path"), F.col("fan_out").alias("n")), "file_path"),
            "chunk_stats": lambda: self._chunks.agg(F.count("*").alias("chunks"), F.countDistinct("file_path").alias("files"), F.round(F.avg("cyclomatic_complexity"), 2).alias("mean_complexity")),
        }

    @staticmethod
    def _ranked(rows: DataFrame, tie: str) -> DataFrame:
        return rows.orderBy(F.col("n").desc(), tie)

    @property
    def names(self) -> list[str]:
        return list(self._named)

    def query(self, name: str, limit: int = 20) -> DataFrame:
        """The first rows of a query; an unknown name is an error that lists the known ones."""
        if name not in self._named:
            raise KeyError(f"unknown query {name!r}; known: {', '.join(self._named)}")
        return self._named[name]().limit(limit)
