"""Holding a query's rows against DuckDB's for its SQL."""

from __future__ import annotations

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None:
        return "\0"
    if isinstance(v, float):
        return "\0" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    return str(v)


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    got = con.sql(sql)
    columns = sorted(got.columns)
    at = [got.columns.index(c) for c in columns]
    return columns, sorted(tuple(plain(r[i]) for i in at) for r in got.fetchall())


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
