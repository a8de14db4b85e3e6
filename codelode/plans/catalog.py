"""Catalogue of the core queries: every area's registry in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codelode.plans import evaluations, findings, graphs, knowledge, parsing, progress, records, scalars, searches
from codelode.plans.registry import Query

AREAS = (scalars, parsing, graphs, knowledge, findings, evaluations, searches, progress, records)


def entries() -> dict[str, tuple[Query, str | None]]:
    found: dict[str, tuple[Query, str | None]] = {}
    for area in AREAS:
        clash = found.keys() & area.R.entries.keys()
        if clash:
            raise ValueError(f"queries defined twice: {sorted(clash)}")
        found.update(area.R.entries)
    return found


def flagship(spark: SparkSession, directory: str) -> DataFrame:
    """Language shares of every job."""
    return scalars.language_fingerprint(spark, directory)


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in entries().items() if sql}
