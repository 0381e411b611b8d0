"""Queries of the validation, the KPIs and the chart datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries.profiling import duck_number
from queries.tables import WITH_DIRTY, dirty_orders, table
from tablecare import compare, profile, roll_up, scorecard, validate
from tablecare.operators.charts import bins, by_category, candidates, pick, series, shares, span
from tablecare.operators.clean import Derive, DropMissing, Fill, ToNumber, Where
from tablecare.operators.kpi import Kpi, kpis, mean_age_days, mean_days, null_share, share_of_rows
from tablecare.plans.plan import Plan

FIX = Plan([ToNumber(["cust_txt"], id="number"), Fill(["note"], "mode", id="fill_note"),
            DropMissing(["amount"], id="drop_amount"), Where("amount > 100000", id="large"),
            Derive("o_orderkey", "o_orderkey * 9", id="shift")])


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    before = dirty_orders(spark, sf_dir)
    return before, FIX.apply(before)[0]


def validation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _sides(spark, sf_dir)
    return validate(before, after, FIX).select("name", "status")


def validation_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _sides(spark, sf_dir)
    return roll_up(validate(before, after, FIX))


def validation_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _sides(spark, sf_dir)
    return compare(before, after, len(FIX.ops))


KPIS = [
    Kpi("total revenue", "sum(l_extendedprice)", "$", "high"),
    Kpi("mean price", "round(avg(l_extendedprice), 2)", "$", "high"),
    Kpi("return rate", share_of_rows("l_returnflag = 'R'"), "%", "high"),
    Kpi("days shipped", mean_days("DATE '1995-01-01'", "l_shipdate"), "days", "medium"),
    Kpi("age", mean_age_days("l_shipdate", "TIMESTAMP '2005-01-01 12:00:00'"), "days", "low"),
    Kpi("open lines", "count_if(l_linestatus = 'O')", "", "medium"),
    Kpi("parts sold", "count(DISTINCT l_partkey)", "", "low"),
    Kpi("no tax known", null_share("l_tax"), "%", "low"),
    Kpi("order value", "sum(CAST(l_extendedprice * l_quantity AS DECIMAL(20, 2)))", "$", "high"),  # exact cents
    Kpi("broken", "sum(no_such_column)", "$", "high"),
]
_KPI_SQL = [
    "sum(l_extendedprice)", "avg(l_extendedprice)", "count(*) FILTER (l_returnflag = 'R') / count(*) * 100",
    "avg(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)))",
    "avg(floor(epoch(TIMESTAMP '2005-01-01 12:00:00' - l_shipdate) / 86400))",
    "count(*) FILTER (l_linestatus = 'O')", "count(DISTINCT l_partkey)",
    "(count(*) - count(l_tax)) / count(*) * 100", "sum(CAST(l_extendedprice * l_quantity AS DECIMAL(20, 2)))", "sum(NULL::DOUBLE)",
]


def _rounded(values: DataFrame) -> DataFrame:
    return values.withColumn("value", F.round("value", 2)).withColumn("position", F.col("position").cast("bigint"))


def kpi_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(kpis(table(spark, sf_dir, "lineitem"), KPIS))


def kpi_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scorecard(kpis(table(spark, sf_dir, "lineitem"), KPIS)))


def kpi_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = [Kpi("median price", "l_extendedprice", "$", "high", quantile=0.5),
              Kpi("revenue", "sum(l_extendedprice * (1 - l_discount))", "$"),
              Kpi("95th of net price", "l_extendedprice * (1 - l_discount)", "$", quantile=0.95)]
    return kpis(table(spark, sf_dir, "lineitem"), wanted).select("kpi", F.round("value", 2).alias("value"))


def kpi_messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = [Kpi("customers known", share_of_rows("cust_txt rlike '^[0-9]+$'"), "%"),
              Kpi("amount missing", null_share("amount"), "%"), Kpi("statuses", "count(DISTINCT status)")]
    return _rounded(kpis(dirty_orders(spark, sf_dir), wanted))


def _kpi_rows(wanted: list[str]) -> str:
    parts = [f"""SELECT {i}::BIGINT AS position, '{k.name}' AS kpi, round(({sql})::DOUBLE, 2) AS "value",
        '{k.unit}' AS unit, '{k.priority}' AS priority FROM lineitem""" for i, (k, sql) in enumerate(zip(KPIS, wanted))]
    return " UNION ALL ".join(parts)


def span_of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = span(table(spark, sf_dir, "orders"), "o_orderdate").select(F.lit("orders").alias("name"), "days", "period")
    events = span(table(spark, sf_dir, "events"), "ts").select(F.lit("events").alias("name"), "days", "period")
    return orders.unionByName(events)


def _rounded_series(df: DataFrame) -> DataFrame:
    return df.select("bucket", F.round("value", 2).alias("value"))


def series_month_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_series(series(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "sum"))


def series_day_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_series(series(table(spark, sf_dir, "events"), "ts", "value", "mean"))


def series_day_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum per day where the buckets between the few dates are empty."""
    events = table(spark, sf_dir, "events").withColumn("t", F.expr("date_trunc('week', ts)"))
    return _rounded_series(series(events, "t", "value", "sum"))


def series_week_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("t", F.expr("date_add(DATE'2024-01-03', CAST(o_custkey % 150 AS INT))"))
    return _rounded_series(series(orders, "t", "o_totalprice", "sum"))


def bars_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_category(dirty_orders(spark, sf_dir), "priority", "amount", "mean").withColumn("value", F.round("value", 4))


def bars_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_category(table(spark, sf_dir, "part"), "p_brand", "p_retailprice", "sum").withColumn("value", F.round("value", 2))


def pie_event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(table(spark, sf_dir, "events"), "event_type")


def histogram_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bins(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return found.select("bin", "n", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


def chart_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = candidates(profile(table(spark, sf_dir, "orders")))
    return found.select("column", "role", "distinct", "money", F.round("std", 4).alias("std"))


def chart_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick(profile(table(spark, sf_dir, "lineitem"))).withColumn("slot", F.col("slot").cast("bigint"))


_BEFORE_AFTER = f"""{WITH_DIRTY}, mode AS (SELECT note FROM dirty WHERE note IS NOT NULL GROUP BY note ORDER BY count(*) DESC, note LIMIT 1),
    fixed AS (SELECT dirty.* REPLACE (o_orderkey * 9 AS o_orderkey, {duck_number('cust_txt')} AS cust_txt,
    coalesce(dirty.note, mode.note) AS note) FROM dirty, mode WHERE amount > 100000)"""
_COLUMNS = ("o_orderkey", "amount", "cust_txt", "mixed_txt", "priority", "status", "date_txt", "note", "answer", "constant_col")
_CHECKS = f"""{_BEFORE_AFTER}, checks AS (
    SELECT 'row_count' AS name, CASE WHEN d > 0.5 THEN 'FAIL' WHEN d > 0.2 OR d < 0 THEN 'WARNING' ELSE 'PASS' END AS status
      FROM (SELECT 1 - (SELECT count(*) FROM fixed) / (SELECT count(*) FROM dirty) AS d)
    UNION ALL SELECT 'schema', 'PASS'
    UNION ALL SELECT 'nulls_note', CASE WHEN count(*) > count(note) THEN 'WARNING' ELSE 'PASS' END FROM fixed
    UNION ALL SELECT 'nulls_amount', CASE WHEN count(*) > count(amount) THEN 'WARNING' ELSE 'PASS' END FROM fixed
    {"".join(f'''UNION ALL SELECT 'distribution_{c}', CASE WHEN abs((SELECT avg({c}) FROM fixed) - avg({c})) / stddev_samp({c}) > 2
      THEN 'WARNING' ELSE 'PASS' END FROM dirty ''' for c in ("o_orderkey", "amount"))}
    UNION ALL SELECT 'duplicates', 'PASS'
    {"".join(f"UNION ALL SELECT 'dtype_{c}', 'PASS' " for c in _COLUMNS if c != "cust_txt")})"""
_NULLS = " + ".join(f"count(*) - count({c})" for c in _COLUMNS)
_PERIOD = "CASE WHEN d > 180 THEN 'month' WHEN d > 30 THEN 'week' ELSE 'day' END"

QUERIES = {
    "validate_checks": (validation_checks, f"{_CHECKS} SELECT name, status FROM checks"),
    "validate_roll_up": (validation_roll_up, f"""{_CHECKS} SELECT CASE WHEN f > 0 THEN 'FAIL' WHEN w > 0 THEN 'WARNING' ELSE 'PASS' END AS status,
        f AS fails, w AS warnings, p AS passes, CASE WHEN f > 0 THEN 'FAIL' WHEN w > 0 THEN 'WARNING' ELSE 'PASS' END
        || ': ' || f || ' failed, ' || w || ' warnings, ' || p || ' passed' AS summary FROM (SELECT
        count(*) FILTER (status = 'FAIL') AS f, count(*) FILTER (status = 'WARNING') AS w, count(*) FILTER (status = 'PASS') AS p FROM checks)"""),
    "validate_compare": (validation_compare, f"""{_BEFORE_AFTER}
        SELECT 'rows' AS measure, (SELECT count(*) FROM dirty) AS "before", (SELECT count(*) FROM fixed) AS "after"
        UNION ALL SELECT 'columns', 10, 10
        UNION ALL SELECT 'nulls', (SELECT {_NULLS} FROM dirty), (SELECT {_NULLS} FROM fixed)
        UNION ALL SELECT 'ops_applied', NULL, 5"""),
    "kpi_set": (kpi_set, _kpi_rows(_KPI_SQL)),
    "kpi_scorecard": (kpi_scorecard, f"""SELECT * FROM ({_kpi_rows(_KPI_SQL)}) WHERE "value" IS NOT NULL
        ORDER BY priority <> 'high', position LIMIT 6"""),
    "kpi_medians": (kpi_medians, """SELECT 'median price' AS kpi, round(quantile_cont(l_extendedprice, 0.5), 2) AS "value" FROM lineitem
        UNION ALL SELECT 'revenue', round(sum(l_extendedprice * (1 - l_discount)), 2) FROM lineitem
        UNION ALL SELECT '95th of net price', round(quantile_cont(l_extendedprice * (1 - l_discount), 0.95), 2) FROM lineitem"""),
    "kpi_messy_orders": (kpi_messy, f"""{WITH_DIRTY}
        SELECT 0::BIGINT AS position, 'customers known' AS kpi, round(count(*) FILTER (regexp_matches(cust_txt, '^[0-9]+$')) / count(*) * 100, 2) AS "value", '%' AS unit, 'medium' AS priority FROM dirty
        UNION ALL SELECT 1, 'amount missing', round((count(*) - count(amount)) / count(*) * 100, 2), '%', 'medium' FROM dirty
        UNION ALL SELECT 2, 'statuses', count(DISTINCT status), '', 'medium' FROM dirty"""),
    "chart_span": (span_of_tables, f"""SELECT name, d AS days, {_PERIOD} AS period FROM (
        SELECT 'orders' AS name, floor(epoch(max(o_orderdate) - min(o_orderdate)) / 86400)::BIGINT AS d FROM orders
        UNION ALL SELECT 'events', floor(epoch(max(ts) - min(ts)) / 86400)::BIGINT FROM events)"""),
    "chart_series_month": (series_month_sum, """WITH b AS (SELECT last_day(o_orderdate) AS bucket, sum(o_totalprice) AS v FROM orders GROUP BY 1)
        SELECT s.bucket, round(coalesce(v, 0), 2) AS "value" FROM (SELECT last_day(d) AS bucket FROM (SELECT unnest(generate_series(
        (SELECT date_trunc('month', min(o_orderdate)) FROM orders), (SELECT max(o_orderdate) FROM orders), INTERVAL 1 MONTH)) AS d)) s
        LEFT JOIN b ON b.bucket = s.bucket"""),
    "chart_series_day": (series_day_mean, """SELECT CAST(ts AS DATE) AS bucket, round(avg("value"), 2) AS "value" FROM events GROUP BY 1"""),
    "chart_series_day_gaps": (series_day_gaps, """WITH e AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS d, "value" AS v FROM events)
        SELECT CAST(s.d AS DATE) AS bucket, round(coalesce(sum(v), 0), 2) AS "value" FROM (SELECT unnest(generate_series(
        (SELECT min(d) FROM e), (SELECT max(d) FROM e), INTERVAL 1 DAY)) AS d) s LEFT JOIN e ON e.d = s.d GROUP BY 1"""),
    "chart_series_week": (series_week_sum, """WITH o AS (SELECT DATE '2024-01-03' + (o_custkey % 150)::INT AS d, o_totalprice AS p FROM orders)
        SELECT d + ((7 - isodow(d)) % 7)::INT AS bucket, round(sum(p), 2) AS "value" FROM o GROUP BY 1"""),
    "chart_bars_mean": (bars_mean, f"""{WITH_DIRTY} SELECT priority AS label, round(avg(amount), 4) AS "value" FROM dirty
        GROUP BY priority ORDER BY avg(amount) DESC, priority LIMIT 12"""),
    "chart_bars_sum": (bars_sum, """SELECT p_brand AS label, round(sum(p_retailprice), 2) AS "value" FROM part
        GROUP BY p_brand ORDER BY sum(p_retailprice) DESC, p_brand LIMIT 12"""),
    "chart_pie": (pie_event_types, """SELECT event_type AS label, count(*) AS n FROM events GROUP BY event_type
        ORDER BY n DESC, label LIMIT 8"""),
    "chart_histogram": (histogram_bins, """WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
        b AS (SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 30)) + 1, 30)::BIGINT AS bin FROM lineitem, m)
        SELECT bin, count(*) AS n, round(any_value(lo) + (bin - 1) * ((any_value(hi) - any_value(lo)) / 30), 4) AS low,
        round(any_value(lo) + bin * ((any_value(hi) - any_value(lo)) / 30), 4) AS high FROM b, m GROUP BY bin"""),
    "chart_candidates": (chart_candidates, """WITH f AS (
        SELECT 'o_orderkey' AS "column", 'n' AS k, count(DISTINCT o_orderkey) AS d, false AS money, round(stddev_samp(o_orderkey), 4) AS std, count(*) AS n FROM orders
        UNION ALL SELECT 'o_custkey', 'n', count(DISTINCT o_custkey), false, round(stddev_samp(o_custkey), 4), count(*) FROM orders
        UNION ALL SELECT 'o_totalprice', 'n', count(DISTINCT o_totalprice), true, round(stddev_samp(o_totalprice), 4), count(*) FROM orders
        UNION ALL SELECT 'o_orderdate', 'd', count(DISTINCT o_orderdate), false, NULL, count(*) FROM orders
        UNION ALL SELECT 'o_orderstatus', 't', count(DISTINCT o_orderstatus), false, NULL, count(*) FROM orders
        UNION ALL SELECT 'o_orderpriority', 't', count(DISTINCT o_orderpriority), false, NULL, count(*) FROM orders)
        SELECT "column", 'numeric' AS role, d AS "distinct", money, std FROM f WHERE k = 'n' AND d > 5
        UNION ALL SELECT "column", 'date', d, money, std FROM f WHERE k = 'd'
        UNION ALL SELECT "column", 'category', d, money, std FROM f WHERE k = 't' AND d BETWEEN 2 AND 25 AND d / n < 0.8
        UNION ALL SELECT "column", 'pie', d, money, std FROM f WHERE k = 't' AND d BETWEEN 2 AND 8"""),
    "chart_pick": (chart_pick, """WITH f AS (SELECT unnest(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_extendedprice', 'l_quantity']) AS c,
        unnest([stddev_samp(l_orderkey), stddev_samp(l_partkey), stddev_samp(l_suppkey), stddev_samp(l_extendedprice), stddev_samp(l_quantity)]) AS s FROM lineitem),
        w AS (SELECT c, row_number() OVER (ORDER BY s DESC) AS r FROM f),
        l AS (SELECT unnest(['l_returnflag', 'l_linestatus']) AS c, unnest([count(DISTINCT l_returnflag), count(DISTINCT l_linestatus)]) AS d FROM lineitem),
        b AS (SELECT c, row_number() OVER (ORDER BY d DESC, c DESC) AS r FROM l)
        SELECT 1::BIGINT AS slot, 'series' AS chart, 'l_shipdate' AS x, 'l_extendedprice' AS y, 'sum' AS agg
        UNION ALL SELECT 1 + r, 'bars', c, 'l_extendedprice', 'sum' FROM b
        UNION ALL SELECT 4, 'pie', c, NULL, NULL FROM b WHERE r = 1
        UNION ALL SELECT 4 + r, 'histogram', c, NULL, NULL FROM w WHERE r <= 2"""),
}
