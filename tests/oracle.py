"""Compares a query with its SQL in DuckDB: same columns, same rows in any order."""

from __future__ import annotations

import math
import os

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return f"{x:.6g}"
    return str(x)


def difference(spark_rows, columns, con, sql: str) -> str:
    got = sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in spark_rows)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != sorted(columns):
        return f"columns {sorted(columns)} against {sorted(names)}"
    at = [names.index(c) for c in sorted(names)]
    want = sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    if got == want:
        return ""
    extra, missing = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
    return f"{len(got)} rows against {len(want)}; only here {extra}; only there {missing}"
