"""Rows of a query beside those of its SQL, in any order, with columns by name."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if hasattr(v, "item"):
        return plain(v.item())
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(plain(x) for x in v)
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def connection(d: str):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(d).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def differing(spark, d: str, query, sql: str, c=None) -> str | None:
    """What differs, None if nothing does."""
    df = query(spark, d)
    a = rows(df.columns, df.collect())
    got = (c or connection(d)).execute(sql)
    b = rows([x[0] for x in got.description], got.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} and {len(b[1])} rows: {[x for x in a[1] if x not in b[1]][:2]} {[x for x in b[1] if x not in a[1]][:2]}"
    bad = [(x, y) for x, y in zip(a[1], b[1], strict=True) if x != y]
    return f"{len(bad)} of {len(a[1])} rows differ: {bad[:2]}" if bad else None
