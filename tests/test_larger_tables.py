"""Registered queries on tables other than the given ones: larger copies, and values where roundings part."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_DIR
from tablecare.operators.charts import bins


def rows_of(spark, folder, name):
    """The rows of a query and of its twin, which reads the same one table."""
    found = entry.queries()[name](spark, str(folder))
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in folder.iterdir():
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    wanted = con.execute(f"SELECT {', '.join(found.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    return sorted(map(repr, map(tuple, found.collect()))), sorted(map(repr, wanted))


@pytest.mark.parametrize("prices", [(900.68, 35579.33, 104936.63), (900.68, 63323.15, 104938.13), (900.68, 42516.04, 104939.08)])
def test_prices_at_the_bound_of_a_bin(spark, tmp_path, prices):
    spark.createDataFrame([(p,) for p in prices], "l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    found, wanted = rows_of(spark, tmp_path, "chart_histogram")
    assert found == wanted


def test_bins_narrower_than_any_number(spark):
    tiny = spark.createDataFrame([(0.0,), (5e-324,)], "v double")
    assert [(r["bin"], r["n"]) for r in bins(tiny, "v").collect()] == [(1, 2)]


def test_proposals_applied_where_amounts_repeat(spark, tmp_path):
    """In copies of a table amounts are no longer identifiers, so that filling them is proposed; the query leaves them."""
    copies = spark.read.parquet(f"{SF_DIR}/orders.parquet").crossJoin(spark.range(3)).selectExpr(
        "o_orderkey + 10000 * id AS o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    copies.write.parquet(str(tmp_path / "orders.parquet"))
    proposed = {(r["column"], r["how"]) for r in entry.queries()["plan_proposals"](spark, str(tmp_path)).collect()}
    assert ("amount", "median") in proposed
    found, wanted = rows_of(spark, tmp_path, "plan_proposals_applied")
    assert found == wanted
