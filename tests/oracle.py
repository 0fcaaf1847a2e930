"""Holds each registered query against its SQL text in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb


def connection(sf_dir: str):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        name = f.removesuffix(".parquet")
        path = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return float(v) if type(v).__name__ == "Decimal" else v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


def differences(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same columns and rows."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows_of(list(rel.columns), rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    if got == want:
        return ""
    odd = next(((a, b) for a, b in zip(got, want) if a != b), (got[-1:], want[-1:]))
    return f"{len(got)} and {len(want)} rows; first difference {odd[0]} and {odd[1]}"
