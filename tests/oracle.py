"""Compares a query with its SQL on the same tables: same columns, same rows in any order."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    flat = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(flat(r[k]) for k in order) for r in values), key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def differences(df, sql: str, sf_dir: str) -> str:
    """What is different, in words; "" if nothing is."""
    rel = duck(sf_dir).sql(sql)
    names, theirs = list(rel.columns), rel.fetchall()
    mine = [tuple(r) for r in df.collect()]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows(df.columns, mine), rows(names, theirs)
    if len(a) != len(b):
        return f"{len(a)} rows, not {len(b)}"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} of {len(a)} rows, as {bad[0]}" if bad else ""
