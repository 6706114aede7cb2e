"""Compares registered queries with their SQL in DuckDB: columns, then rows as multisets."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.10g}")
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def _rows(columns, rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(spark_df, connection, sql: str) -> str | None:
    cursor = connection.execute(sql)
    want_columns, want = _rows([d[0] for d in cursor.description], cursor.fetchall())
    got_columns, got = _rows(spark_df.columns, spark_df.collect())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if got != want:
        return (f"rows {sum(got.values())} vs {sum(want.values())}; "
                f"only spark {list((got - want).items())[:3]}; only sql {list((want - got).items())[:3]}")
    if not want:
        return "no rows"
    return None
