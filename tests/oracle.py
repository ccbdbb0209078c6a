"""Rows of a Spark query against those of its SQL twin, as multisets."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool):
        return v
    return int(v) if hasattr(v, "to_integral_value") and v == v.to_integral_value() else v


def duck(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    c.sql("set threads = 8")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        c.sql(f"create view {p.stem} as from '{p}'")
    return c


def differences(spark, query, sql: str, sf_dir: str, con=None) -> str:
    """What differs, or an empty text."""
    got = query(spark, sf_dir)
    want = (con or duck(sf_dir)).sql(sql)
    names = sorted(got.columns)
    if names != sorted(want.columns):
        return f"columns {names} and {sorted(want.columns)}"
    at = [want.columns.index(n) for n in names]
    a = Counter(tuple(plain(r[n]) for n in names) for r in got.collect())
    b = Counter(tuple(plain(r[k]) for k in at) for r in want.fetchall())
    if a == b:
        return ""
    return f"{sum(a.values())} and {sum(b.values())} rows; only Spark {list((a - b).items())[:4]}; only SQL {list((b - a).items())[:4]}"
