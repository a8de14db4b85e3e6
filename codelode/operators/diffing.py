"""Differences between two states: stored against current rows, and one report against another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diff(current: DataFrame, stored: DataFrame, key: str, value: str) -> DataFrame:
    """JOI1: (key, change) with change new, updated, unchanged or deleted, by one full outer hash join.

    Both sides are reduced to one row for a key first (its greatest value). A value that became or was
    null counts as updated unless it is null on both sides; rows with a null key are left out.
    """
    one = lambda df: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(value).alias(value))
    c, s = one(current).alias("c").withColumn("in_c", F.lit(True)), one(stored).alias("s").withColumn("in_s", F.lit(True))
    c, s = c.withColumnRenamed(value, "now"), s.withColumnRenamed(value, "before")
    change = F.when(F.col("in_s").isNull(), "new").when(F.col("in_c").isNull(), "deleted").when(F.col("now").eqNullSafe(F.col("before")), "unchanged").otherwise("updated")
    return c.join(s, key, "full_outer").select(key, change.alias("change"))


def compare_reports(before: DataFrame, after: DataFrame, signature: str) -> DataFrame:
    """JOI12: (signature, status) with status resolved, new or persisting; repeated signatures count once."""
    a = before.select(signature).where(F.col(signature).isNotNull()).distinct().withColumn("in_a", F.lit(True))
    b = after.select(signature).where(F.col(signature).isNotNull()).distinct().withColumn("in_b", F.lit(True))
    status = F.when(F.col("in_b").isNull(), "resolved").when(F.col("in_a").isNull(), "new").otherwise("persisting")
    return a.join(b, signature, "full_outer").select(signature, status.alias("status"))


def upsert(stored: DataFrame, changed: DataFrame, key: str, deleted: DataFrame | None = None) -> DataFrame:
    """SNK1, SNK3: stored rows without those changed or deleted, and the changed rows (same columns)."""
    gone = changed.select(key) if deleted is None else changed.select(key).unionAll(deleted.select(key))
    return stored.join(gone.distinct(), key, "left_anti").select(*changed.columns).unionByName(changed)


def first_of(df: DataFrame, keys: list[str], order: list, keep: int = 1) -> DataFrame:
    """WIN6: the first rows of every key in an explicit order (ties by the order given, so make it total)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where(F.col("__place") <= keep).drop("__place")
