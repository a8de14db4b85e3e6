"""Compares a query's rows with its SQL in DuckDB over the same parquet tables."""

from pathlib import Path

import duckdb


def duck(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(directory).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sql_rows(directory: str, sql: str, columns: list[str]) -> list[tuple]:
    con = duck(directory)
    return sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall(), key=repr)
