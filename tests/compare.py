"""Compare a DataFrame with SQL that DuckDB runs over the same Parquet tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def plain(value):
    """Values in a form in which both engines agree."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}" if value else "0"
    if isinstance(value, (list, tuple)):
        return str([plain(x) for x in value])
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, dict):
        return str({k: plain(v) for k, v in value.items()})
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


def sorted_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def from_sql(sql: str, sf_dir) -> tuple[list[str], list[tuple]]:
    with duckdb.connect() as con:
        con.execute("SET timezone = 'UTC'")
        for path in Path(sf_dir).glob("*.parquet"):
            files = f"{path}/*.parquet" if path.is_dir() else path
            con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{files}')")
        got = con.execute(sql)
        return [c[0] for c in got.description], got.fetchall()


def assert_same(df, sql: str, sf_dir) -> None:
    columns, rows = from_sql(sql, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(columns, rows)
