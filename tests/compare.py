"""Run a query and its SQL check side by side and compare whole results."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _cell(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.9g}"
    if isinstance(value, (dt.datetime, dt.date)):
        return str(value)[:10]
    return repr(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(df, db, sql: str) -> tuple[int, list]:
    """Number of rows and the first differences (empty when equal)."""
    mine = rows_of(df.columns, df.collect())
    cursor = db.execute(sql)
    columns = [d[0] for d in cursor.description]
    theirs = rows_of(columns, cursor.fetchall())
    if sorted(df.columns) != sorted(columns):
        return len(mine), [("columns", sorted(df.columns), sorted(columns))]
    if mine == theirs:
        return len(mine), []
    extra, missing = sorted(set(mine) - set(theirs)), sorted(set(theirs) - set(mine))
    return len(mine), [("rows", len(mine), len(theirs)), ("only spark", extra[:4]), ("only sql", missing[:4])]
