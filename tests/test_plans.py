"""Plans are looked at, so that they keep the shape that holds at scale."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from queries.tables import dirty_orders, table
from tablecare import Kpi, kpis
from tablecare.operators.charts import by_category, shares
from tablecare.operators.clean import Dedupe, Strip, Title, ToNumber, ToTimestamp, Where
from tablecare.operators.histogram import top_values, value_counts
from tablecare.operators.profile import duplicate_count, null_report
from tablecare.operators.samples import sample_rows


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def executed(df) -> str:
    df.collect()
    return plan(df)


@pytest.mark.parametrize("name", ["clean_strip", "clean_to_timestamp", "clean_title", "clean_map_labels", "plan_run", "kpi_set", "chart_series_month",
                                  "catalog_domains", "replies_good", "validate_checks", "profile_duplicates_documents"])
def test_no_python_and_no_cross_join(spark, sf_dir, name):
    text = plan(entry.queries()[name](spark, sf_dir))
    assert not re.search(r"PythonUDF|EvalPython|InPandas|MapPartitions|CartesianProduct|BroadcastNestedLoopJoin", text)


def test_row_wise_steps_are_one_stage(spark, sf_dir):
    df = dirty_orders(spark, sf_dir)
    for op in (Strip(["priority"]), ToNumber(["cust_txt"]), ToTimestamp(["date_txt"]), Title(["status"]), Where("amount > 5")):
        df = op.apply(df)
    assert "Exchange" not in plan(df)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    df = Where("o_totalprice > 1000").apply(table(spark, sf_dir, "orders")).select("o_orderkey", "o_totalprice")
    assert "GreaterThan(o_totalprice,1000.0)" in plan(df)
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan(df)


def test_kpis_share_one_scan(spark, sf_dir):
    wanted = [Kpi("a", "sum(l_tax)"), Kpi("b", "avg(l_discount)"), Kpi("c", "count_if(l_tax > 0)")]
    text = plan(kpis(table(spark, sf_dir, "lineitem"), wanted))
    assert text.count("FileScan parquet") == 1 and text.count("Exchange") == 1


def test_tops_are_not_full_sorts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    for df in (by_category(orders, "o_orderpriority", "o_totalprice"), shares(orders, "o_orderstatus")):
        assert "TakeOrderedAndProject" in plan(df) and "rangepartitioning" not in plan(df)
    assert plan(sample_rows(orders, ["o_orderkey"])).count("TakeOrderedAndProject") == 3


def test_ranks_are_cut_before_the_shuffle(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    assert plan(Dedupe(["o_custkey"], ["o_orderkey"]).apply(orders)).count("WindowGroupLimit") == 2
    assert plan(top_values(value_counts(orders, {"0": F.col("o_custkey")}), 5)).count("WindowGroupLimit") == 2


def test_histogram_is_shuffled_once_for_metrics_and_top_values(spark, sf_dir):
    counts = value_counts(table(spark, sf_dir, "orders"), {"0": F.col("o_custkey")})
    both = counts.groupBy("pos").agg(F.sum("n").alias("n")).unionByName(top_values(counts, 5), allowMissingColumns=True)
    assert "ReusedExchange" in executed(both)


def test_counts_combine_before_the_shuffle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("text")
    text = plan(duplicate_count(docs))
    assert text.index("sha2") > text.index("partial_count")
    assert plan(null_report(docs)).count("Exchange") == 1
