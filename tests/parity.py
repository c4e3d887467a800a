"""Compares registered queries with their SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return ("nan",) if math.isnan(value) else round(value, 6) + 0.0
    return str(value) if hasattr(value, "isoformat") else value


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both have the same columns and rows."""
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    if got == want:
        return ""
    first = next(((g, w) for g, w in zip(got, want, strict=False) if g != w), None)
    return f"{len(got)} and {len(want)} rows; first difference {first}"
