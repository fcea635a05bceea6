"""Runs a query in Spark and its SQL in DuckDB on the same tables, and compares the rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def _norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(_norm, v))
    return str(v)


def rows_of(cols: list[str], rows) -> Counter:
    order = sorted(range(len(cols)), key=lambda i: cols[i].lower())
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, sf: str, name: str, query, sql: str) -> str | None:
    """None if equal, else what differs."""
    df = query(spark, sf)
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    if sorted(c.lower() for c in cols) != sorted(c.lower() for c in df.columns):
        return f"{name}: columns {sorted(cols)} and {sorted(df.columns)}"
    want, got = rows_of(cols, cur.fetchall()), rows_of(df.columns, [tuple(r) for r in df.collect()])
    if want == got:
        return None
    return f"{name}: {sum(want.values())} and {sum(got.values())} rows; SQL only {list((want - got).items())[:2]}; Spark only {list((got - want).items())[:2]}"
