"""Runs a query in Spark and its SQL in DuckDB on the same tables and compares columns and rows."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet({sorted(glob.glob(path + '/*.parquet')) if os.path.isdir(path) else [path]})")
    return con


def plain(v):  # noqa: ANN001, ANN201
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 9) + 0.0)
    if isinstance(v, decimal.Decimal):
        return f"decimal {v}"
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, bool):
        return str(v)
    return repr(v)


def rows_of(names: list[str], rows: list[tuple]) -> list[tuple[str, ...]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:  # noqa: ANN001
    """Empty if both agree; otherwise what differs."""
    cur = con.execute(sql)
    names, want = [d[0] for d in cur.description], cur.fetchall()
    got = [tuple(r) for r in df.collect()]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return f"rows {len(a)} and {len(b)}"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}" if bad else ""
