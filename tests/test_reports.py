from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablecare import Kpi, kpis, profile, scorecard
from tablecare.operators.catalog import catalog_of, confidence, snake_names, tag_domains, unique_snake_names
from tablecare.operators.charts import bins, by_category, candidates, pick, series, shares, span
from tablecare.operators.kpi import mean_age_days, mean_days, null_share, screen_kpis, share_of_rows
from tablecare.operators.proposals import parse_replies, referenced_columns, screen_proposals, unfence, usage_cost


def sales(spark):
    return spark.createDataFrame([
        (1, "a", 10.0, 2, dt.datetime(2023, 1, 5), dt.datetime(2023, 1, 9)), (2, "b", 20.0, 1, dt.datetime(2023, 1, 6), None),
        (3, "a", None, 5, dt.datetime(2023, 4, 1), dt.datetime(2023, 4, 3)), (4, None, 6.0, 4, None, dt.datetime(2023, 4, 3)),
    ], "id int, kind string, price double, pieces int, sold timestamp, sent timestamp")


def test_kpi_values(spark):
    wanted = [
        Kpi("sum", "sum(price)"), Kpi("rate", share_of_rows("kind = 'a'"), "%"), Kpi("median", "price", quantile=0.5),
        Kpi("wait", mean_days("sold", "sent"), "days"), Kpi("age", mean_age_days("sold", "TIMESTAMP '2023-05-01'")),
        Kpi("value", "sum(price * pieces)"), Kpi("kinds", "count(DISTINCT kind)"), Kpi("null", null_share("kind")),
        Kpi("broken", "sum(nothing)"), Kpi("text", "max(kind)"), Kpi("java", "reflect('java.lang.Math', 'abs', 1)"),
    ]
    found = {r["kpi"]: r["value"] for r in kpis(sales(spark), [k for k in wanted if k.name != "text"]).collect()}
    assert found == {"sum": 36.0, "rate": 50.0, "median": 10.0, "wait": 3.0, "age": 87.0, "value": 64.0, "kinds": 2.0, "null": 25.0,
                     "broken": None, "java": None}
    assert "broken" not in {k.name for k in screen_kpis(sales(spark), wanted)}


def test_a_share_of_no_rows_is_null(spark):
    found = kpis(sales(spark).where("id < 0"), [Kpi("rate", share_of_rows("kind = 'a'"))]).first()
    assert found["value"] is None


def test_scorecard_order_and_length(spark):
    wanted = [Kpi(f"k{i}", "count(*)" if i != 2 else "sum(CAST(NULL AS INT))", priority="high" if i in (2, 5) else "low") for i in range(9)]
    shown = [r["kpi"] for r in scorecard(kpis(sales(spark), wanted)).collect()]
    assert shown == ["k5", "k0", "k1", "k3", "k4", "k6"]


@pytest.mark.parametrize("days, period", [(30, "day"), (31, "week"), (180, "week"), (181, "month")])
def test_period_follows_from_the_span(spark, days, period):
    df = spark.sql(f"SELECT explode(array(TIMESTAMP'2023-01-01', TIMESTAMP'2023-01-01' + INTERVAL {days} DAYS)) AS t")
    assert span(df, "t").first()["period"] == period


def test_series_fills_gaps_of_sums_only(spark):
    summed = {r["bucket"]: r["value"] for r in series(sales(spark), "sold", "price", "sum").collect()}
    assert summed[dt.date(2023, 1, 8)] == 30.0 and summed[dt.date(2023, 1, 15)] == 0.0 and summed[dt.date(2023, 4, 2)] == 0.0
    assert len(summed) == 13
    means = {r["bucket"]: r["value"] for r in series(sales(spark), "sold", "price", "mean").collect()}
    assert means == {dt.date(2023, 1, 8): 15.0}
    with pytest.raises(ValueError):
        series(sales(spark), "sold", "price", "max")


def test_series_of_month_ends(spark):
    df = spark.sql("SELECT explode(array(TIMESTAMP'2022-01-31', TIMESTAMP'2022-08-30 10:00:00')) AS t, 1 AS v")
    buckets = sorted(r["bucket"] for r in series(df, "t", "v").collect())
    assert buckets[0] == dt.date(2022, 1, 31) and buckets[1] == dt.date(2022, 2, 28) and buckets[-1] == dt.date(2022, 8, 31) and len(buckets) == 8


def test_bars_and_shares(spark):
    assert [tuple(r) for r in by_category(sales(spark), "kind", "price", "sum").collect()] == [("b", 20.0), ("a", 10.0)]
    assert [tuple(r) for r in shares(sales(spark), "kind").collect()] == [("a", 2), ("b", 1)]


def test_bins(spark):
    df = spark.range(0, 301).selectExpr("CAST(id AS DOUBLE) AS v").union(spark.sql("SELECT double('inf')")).union(spark.sql("SELECT double('nan')"))
    found = bins(df, "v").collect()
    assert len(found) == 30 and sum(r["n"] for r in found) == 301
    assert {r["bin"]: r["n"] for r in found}[30] == 11
    assert [(r["bin"], r["n"]) for r in bins(spark.sql("SELECT 4.0D AS v FROM range(3)"), "v").collect()] == [(1, 3)]
    assert bins(spark.sql("SELECT CAST(NULL AS DOUBLE) AS v"), "v").count() == 0


def test_choice_of_charts(spark):
    df = spark.range(60).selectExpr("CAST(id AS DOUBLE) AS weight", "id * 2.5D AS unit_price", "id AS row", "id % 5 AS few",
                                    "DATE'2023-01-01' + CAST(id AS INT) AS day", "concat('c', id % 20) AS city", "concat('g', id % 3) AS grade")
    result = profile(df)
    roles = {(r["column"], r["role"]) for r in candidates(result).collect()}
    assert roles == {("weight", "numeric"), ("unit_price", "numeric"), ("day", "date"), ("city", "category"), ("grade", "category"), ("grade", "pie")}
    chosen = [tuple(r) for r in pick(result).orderBy("slot").collect()]
    assert chosen == [(1, "series", "day", "unit_price", "sum"), (2, "bars", "city", "unit_price", "sum"), (3, "bars", "grade", "unit_price", "sum"),
                      (4, "pie", "grade", None, None), (5, "histogram", "unit_price", None, None), (6, "histogram", "weight", None, None)]
    assert pick(result, 2).count() == 2
    assert pick(profile(df.select("grade"))).count() == 1 and pick(profile(df.select("city"))).isEmpty()


def test_snake_names_stay_unique_within_a_table(spark):
    rows = [("t", i, c) for i, c in enumerate(["Net", "net", "net_2", "NET", "net_2_2"])] + [("u", 0, "Net")]
    found = {(r["table"], r["pos"]): r["new_name"] for r in snake_names(spark.createDataFrame(rows, "table string, pos int, column string")).collect()}
    assert len({v for (t, _), v in found.items() if t == "t"}) == 5
    assert found["t", 0] == "net" and found["t", 1].startswith("net_2") and found["u", 0] == "net"
    assert unique_snake_names(spark, []) == []
    assert unique_snake_names(spark, ["Sum", "sum", "SUM"]) == ["sum", "sum_2", "sum_3"]


def test_domains(spark):
    tables = {"wards": ["patient_id", "Diagnosis", "ward", "blood-pressure"], "depot": ["Lead Time", "supplier", "route"],
              "odd": ["leadtime", "orders"], "lead.time": ["lead.time"]}
    rows = [(t, i, c) for t, cols in tables.items() for i, c in enumerate(cols)]
    found = {(r["table"], r["rank"]): (r["domain"], r["score"], r["confidence"])
             for r in tag_domains(spark.createDataFrame(rows, "table string, pos int, column string")).collect()}
    assert found["wards", 1] == ("Healthcare", 3, "high")
    assert found["depot", 1] == ("Logistics / Supply Chain", 3, "high")
    assert found["depot", 2][1] == 1 and ("odd", 1) not in found
    # a dot parts words: no lead time, but a lead
    assert found["lead.time", 1] == ("Marketing / CRM", 1, "high") and ("lead.time", 2) not in found


@pytest.mark.parametrize("score, columns, sure", [(4, 100, "high"), (2, 5, "high"), (3, 100, "medium"), (1, 5, "medium"), (1, 6, "low"), (0, 0, "low")])
def test_confidence(spark, score, columns, sure):
    assert spark.range(1).select(confidence(F.lit(score), F.lit(columns))).first()[0] == sure


def test_catalog_of_tables(spark):
    rows = catalog_of({"a": spark.range(1), "b": sales(spark)}).collect()
    assert len(rows) == 7 and rows[0]["column"] == "id"


@pytest.mark.parametrize("text, body", [
    ("[1]", "[1]"), ("```\n[1]\n```", "[1]"), (" ```json\n[1]``` ", "[1]"), ("```JSON\n{\n}\n```", "{\n}"), ("`[1]`", "[1]"), ("so: ```[1]```", "so: ```[1]```")])
def test_unfence(spark, text, body):
    assert spark.createDataFrame([(text,)], "t string").select(unfence(F.col("t"))).first()[0] == body


def step(**changes):
    import json

    op = {"id": "i", "type": "fix_dtype", "description": "d", "impact": "m", "confidence": "low", "reversible": True, "code": "c", **changes}
    return json.dumps({"operations": [{k: v for k, v in op.items() if v is not None}]})


@pytest.mark.parametrize("reply, reason", [
    (step(), None), ("```json\n" + step() + "\n```", None), (step() + ",", "json"), ("", "json"), (step(confidence="sure"), "schema"),
    (step(type="explode"), "schema"), (step(code=None), "schema"), (step(reversible="maybe"), "schema"), ('{"ops": []}', "schema"), ("[1]", "schema"),
    ('{"operations": []}', None),
])
def test_replies(spark, reply, reason):
    good, rejects = parse_replies(spark.createDataFrame([("d", reply)], "dataset string, reply string"), "reply")
    assert [r["reason"] for r in rejects.collect()] == ([reason] if reason else [])
    assert good.count() == (1 if reason is None and "[]" not in reply else 0)


def test_columns_named_in_code(spark):
    df = spark.createDataFrame([("df['a'] + df[\"b c\"] / df['a'].max() - df.d",)], "code string")
    assert df.select(referenced_columns(F.col("code"))).first()[0] == ["a", "b c"]


def test_screening_drops_the_whole_proposal(spark):
    ops = spark.createDataFrame([("d", 1, ["a", "x"]), ("d", 2, ["a"]), ("e", 1, ["x"]), ("e", 2, [])], "dataset string, id int, cols array<string>")
    known = spark.createDataFrame([("d", "a"), ("e", "x")], "dataset string, column string")
    kept, dropped = screen_proposals(ops, known, F.col("cols"))
    assert sorted((r["dataset"], r["id"]) for r in kept.collect()) == [("d", 2), ("e", 1), ("e", 2)]
    assert [tuple(r) for r in dropped.collect()] == [("d", 1, ["x"])]


def test_usage(spark):
    rates = spark.createDataFrame([("m", 3.0, 15.0)], "model string, input_rate double, output_rate double")
    calls = spark.createDataFrame([("m", 1000, 100), ("m", 500, 0), ("other", 9, 9)], "model string, input_tokens bigint, output_tokens bigint")
    assert tuple(usage_cost(calls, rates).first()) == (3, 1509, 109, 1618, 0.006)
    assert tuple(usage_cost(calls.limit(0), rates).first()) == (0, 0, 0, 0, 0.0)
