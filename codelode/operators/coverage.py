"""Which tests reach which sources, and how risky what no test reaches is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What marks a test file in its lower-cased path.
TEST_MARKS = (".test.", ".spec.", "__tests__", "_test.", "_spec.")
TEST_FOLDER = r"(^|[/\\])tests?[/\\]"


def is_test(path: Column) -> Column:
    """JOI10, T30: by marks in the name or a folder test or tests (as a whole segment)."""
    low = F.lower(path)
    found = low.rlike(TEST_FOLDER)
    for mark in TEST_MARKS:
        found = found | low.contains(mark)
    return found


def test_edges(edge: DataFrame) -> DataFrame:
    """JOI10: (source, test) for every import of a source by a test."""
    return edge.where(is_test(F.col("src")) & ~is_test(F.col("dst"))).select(F.col("dst").alias("source"), F.col("src").alias("test"))


def coverage_gaps(chunks: DataFrame, tested: DataFrame, vulnerable: DataFrame) -> DataFrame:
    """RUL8, JOI14: complex chunks with their risk tier: 1 very complex, vulnerable and untested; 2 untested; 3 tested but vulnerable.

    chunks: id, file_path, cyclomatic_complexity; tested: column source; vulnerable: column file_path.
    """
    rows = chunks.where("cyclomatic_complexity > 5")
    t = tested.select(F.col("source").alias("file_path")).distinct().withColumn("tested", F.lit(True))
    v = vulnerable.select("file_path").where("file_path is not null").distinct().withColumn("vulnerable", F.lit(True))
    joined = rows.join(t, "file_path", "left").join(v, "file_path", "left").na.fill(False, ["tested", "vulnerable"])
    tier = F.when((F.col("cyclomatic_complexity") > 10) & F.col("vulnerable") & ~F.col("tested"), 1).when(~F.col("tested"), 2).otherwise(3)
    return joined.withColumn("tier", tier).where("tier <= 2 or vulnerable").select("id", "file_path", "cyclomatic_complexity", "vulnerable", "tested", "tier")
