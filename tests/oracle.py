"""Compares queries with their SQL in DuckDB on one folder of tables."""

from __future__ import annotations

import math
import os
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(os.listdir(sf)):
        q = f"{sf}/{p}" if os.path.isfile(f"{sf}/{p}") else f"{sf}/{p}/*.parquet"
        con.execute(f"CREATE VIEW {p.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{q}')")
    return con


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.5f}".replace("-0.00000", "0.00000")
    return str(v)


def difference(df, con, sql: str) -> str:
    """Empty if both give the same rows."""
    names = sorted(df.columns)
    ours = sorted(tuple(_plain(r[c]) for c in names) for r in df.collect())
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    if sorted(cols) != names:
        return f"columns {names} and {sorted(cols)}"
    at = [cols.index(c) for c in names]
    theirs = sorted(tuple(_plain(r[i]) for i in at) for r in cur.fetchall())
    if ours == theirs:
        return ""
    off = [(a, b) for a, b in zip(ours, theirs, strict=False) if a != b]
    return f"{names}: {len(ours)} and {len(theirs)} rows, {len(off)} differ, such as {off[:2]}"
