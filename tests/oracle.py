"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import decimal
import glob
import os

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v: object) -> str:
    return repr(round(float(v), 6)) if isinstance(v, (float, decimal.Decimal)) else repr(v)


def compare(df, sql: str, sf_dir: str) -> None:
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    c = connection(sf_dir).execute(sql)
    names = [x[0] for x in c.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(n)]) for n in cols) for r in c.fetchall())
    assert got == want
