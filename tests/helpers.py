"""Holds a query's rows against its SQL."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb

from lodestone.plans.views import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.sql(f"create view {name} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(x) -> str:
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return "{" + ",".join(f"{k}:{plain(v)}" for k, v in x.items()) + "}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    if x is None or isinstance(x, (bool, str, bytes, datetime.date)):
        return str(x)
    if isinstance(x, (float, decimal.Decimal)):
        return f"{float(x):.6g}"
    return str(x)


def spark_rows(df) -> list[list[str]]:
    names = sorted(df.columns)
    return sorted([plain(v) for v in r] for r in df.select(*(f"`{n}`" for n in names)).collect())


def sql_rows(con, sql: str) -> tuple[list[str], list[list[str]]]:
    found = con.sql(sql)
    order = sorted(range(len(found.columns)), key=lambda k: found.columns[k])
    return sorted(found.columns), sorted([plain(r[k]) for k in order] for r in found.fetchall())


def assert_same(spark, con, sf_dir: str, run, sql: str) -> None:
    df = run(spark, sf_dir)
    names, expected = sql_rows(con, sql)
    assert sorted(df.columns) == names
    assert spark_rows(df) == expected
