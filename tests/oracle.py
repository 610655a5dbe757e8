"""Run a registered query and its SQL side by side and compare names, rows and values."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from tidelog.fixtures import BASE_TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, float):
        return ("float", "nan" if math.isnan(value) else repr(value))
    if isinstance(value, (datetime.datetime, datetime.date)):
        return (type(value).__name__, value.isoformat())
    return (type(value).__name__, str(value))


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short description of the difference."""
    got_names = spark_df.columns
    got = rows_of(got_names, spark_df.collect())
    cur = con.execute(sql)
    want_names = [c[0] for c in cur.description]
    want = rows_of(want_names, cur.fetchall())
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} != {sorted(want_names)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; only spark {sorted(set(got) - set(want))[:2]}, only sql {sorted(set(want) - set(got))[:2]}"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        return f"{len(bad)} of {len(got)} rows differ, first: {bad[0]} columns {sorted(got_names)}"
    if not got:
        return "no rows"
    return None
