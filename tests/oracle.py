"""Holds a Spark result against the same question asked in SQL of another engine."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    """A value in a form that both engines share; doubles to nine significant digits."""
    if isinstance(x, (float, Decimal)):
        x = float(x)
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in sorted(x.items(), key=lambda e: str(e[0]))}
    return x


def same(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(float(a), float(b), rel_tol=1e-8, abs_tol=1e-9)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


def order(row) -> tuple:
    return tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in row)


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        at = Path(f"{sf_dir}/{name}.parquet")
        if at.exists():
            con.execute(f"create view {name} as select * from read_parquet('{at}{'/*.parquet' if at.is_dir() else ''}')")
    return con


def differences(df, sql: str, sf_dir: str) -> list[str]:
    """What differs, in words; empty if the rows are the same in any order."""
    con = connect(sf_dir)
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    if sorted(columns) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(columns)}"]
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    theirs = sorted(([plain(r[i]) for i in at] for r in found.fetchall()), key=order)
    ours = sorted(([plain(r[n]) for n in names] for r in df.collect()), key=order)
    if len(ours) != len(theirs):
        return [f"{len(ours)} rows against {len(theirs)}"]
    return [f"{names}: {a} against {b}" for a, b in zip(ours, theirs, strict=True) if not all(map(same, a, b))][:3]
