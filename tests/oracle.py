"""Compare a registered query with its SQL on the same Parquet tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    return f"{type(value).__name__}:{value}"


def _normal(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty if both sides have the same columns, types (as Python sees them) and rows."""
    cursor = con.execute(sql)
    names = [item[0] for item in cursor.description]
    expected = _normal(names, cursor.fetchall())
    found = _normal(df.columns, df.collect())
    problems = []
    if sorted(names) != sorted(df.columns):
        problems.append(f"columns {sorted(df.columns)} != {sorted(names)}")
    if len(found) != len(expected):
        problems.append(f"{len(found)} rows != {len(expected)}")
    if not expected:
        problems.append("the SQL gives no rows")
    only_found = sorted(set(found) - set(expected))[:3]
    only_expected = sorted(set(expected) - set(found))[:3]
    if only_found or only_expected:
        problems.append(f"only in Spark {only_found}; only in SQL {only_expected}")
    return problems
