"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb


def tables(d: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in Path(d).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p if p.is_file() else p / '*.parquet'}')")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, float):
        return f"{v:.6f}" if v != int(v) else str(int(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def same(df, connection, sql: str) -> None:
    t = connection.sql(sql).arrow()
    t = t.read_all() if hasattr(t, "read_all") else t
    want = list(zip(*[c.to_pylist() for c in t.columns])) if t.num_columns else []
    assert sorted(df.columns) == sorted(t.column_names)
    got = [tuple(r) for r in df.collect()]
    assert rows(df.columns, got) == rows(t.column_names, want)
