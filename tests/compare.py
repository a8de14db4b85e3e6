"""Compares a query's rows with its SQL in DuckDB over the same parquet tables."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb


def duck(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(directory).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float) and math.isfinite(value):
        return round(value, 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def same(spark, directory: str, query, sql: str) -> str:
    """Empty if columns and rows agree, else what differs."""
    df = query(spark, directory)
    result = duck(directory).execute(sql)
    names = [x[0] for x in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    want = sorted((tuple(plain(r[names.index(n)]) for n in order) for r in result.fetchall()), key=repr)
    found = sorted((tuple(plain(r[n]) for n in order) for r in df.collect()), key=repr)
    if want == found:
        return ""
    a, b = set(map(repr, found)), set(map(repr, want))
    return f"{order}: {len(found)} rows and {len(want)}; only here: {sorted(a - b)[:3]}; only in SQL: {sorted(b - a)[:3]}"
