"""Comparison of a Spark query with its SQL twin over the same parquet folder."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb

FOLDER = os.environ.get("CLUEFORGE_TESTDATA", "/root/testdata/sf0.001")


def connection() -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ")[:19]
    return float(v) if type(v).__name__ == "Decimal" else v


def same(spark, query, sql) -> None:
    df = query(spark, FOLDER)
    c = connection()
    cursor = c.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    key = lambda row: tuple((x is None, str(x)) for x in row)
    left = sorted((tuple(plain(r[n]) for n in order) for r in df.collect()), key=key)
    right = sorted((tuple(plain(r[names.index(n)]) for n in order) for r in cursor.fetchall()), key=key)
    assert left == right
