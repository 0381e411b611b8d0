"""Run a registered query and its DuckDB twin and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, t)}.parquet')")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day).isoformat()
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(repr(_plain(r[i])) for i in order) for r in rows]
    return [names[i] for i in order], sorted(plain)


def compare(spark, con, sf_dir: str, run, sql: str | None) -> tuple[str, int]:
    df = run(spark, sf_dir)
    names, rows = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "rows only", len(rows)
    result = con.execute(sql)
    duck_names, duck_rows = _rows([d[0] for d in result.description], result.fetchall())
    if names != duck_names:
        return f"columns differ: {names} / {duck_names}", len(rows)
    if len(rows) != len(duck_rows):
        return f"row count {len(rows)} / {len(duck_rows)}: {rows[:3]} / {duck_rows[:3]}", len(rows)
    for a, b in zip(rows, duck_rows):
        if a != b:
            return f"rows differ: {a} / {b}", len(rows)
    return "same", len(rows)
