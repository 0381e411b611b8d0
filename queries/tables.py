"""Views over the given tables, in the same words for Spark and for DuckDB.

The given tables are clean, so the views make them dirty by rules on the key:
missing amounts, texts among numbers, padded and re-cased labels, two date
formats. Every row of the table stays in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SPARK = {"S": "STRING", "ISO": "date_format({0}, 'yyyy-MM-dd')", "DMY": "date_format({0}, 'dd/MM/yyyy')"}
_DUCK = {"S": "VARCHAR", "ISO": "strftime({0}, '%Y-%m-%d')", "DMY": "strftime({0}, '%d/%m/%Y')"}

DIRTY_ORDERS = """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS amount,
       CASE WHEN o_orderkey % 13 = 0 THEN 'abc' ELSE CAST(o_custkey AS {S}) END AS cust_txt,
       CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS {S})
            ELSE concat('c-', CAST(o_custkey AS {S})) END AS mixed_txt,
       CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderpriority)
            WHEN o_orderkey % 3 = 1 THEN concat(' ', o_orderpriority, ' ')
            ELSE o_orderpriority END AS priority,
       CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' WHEN o_orderkey % 7 = 1 THEN NULL
            WHEN o_orderkey % 7 = 2 THEN ' NA' ELSE o_orderstatus END AS status,
       CASE WHEN o_orderkey % 17 = 0 THEN 'not-a-date'
            WHEN o_orderkey % 2 = 0 THEN {ISO}
            ELSE {DMY} END AS date_txt,
       CASE WHEN o_orderkey % 20 = 0 THEN o_orderpriority END AS note,
       CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'no' END AS answer,
       'x' AS constant_col
FROM orders
"""

# Column names of imagined tables, one table per user: terms, cases and signs vary.
EVENT_CATALOG = """
SELECT concat('user_', CAST(user_id AS {S})) AS "table", event_id AS pos,
       CASE WHEN event_id % 6 = 0 THEN concat(event_type, '_amount')
            WHEN event_id % 6 = 1 THEN concat('Lead-Time ', event_type)
            WHEN event_id % 6 = 2 THEN concat(event_type, ' orderStatus')
            WHEN event_id % 6 = 3 THEN concat('  ', upper(event_type), '-ID (USD)')
            WHEN event_id % 6 = 4 THEN concat(CAST(event_id % 10 AS {S}), 'st ', event_type)
            ELSE concat('lead.time/', event_type) END AS "column"
FROM events
"""


def _words(template: str, engine: dict[str, str]) -> str:
    return template.format(
        S=engine["S"], ISO=engine["ISO"].format("o_orderdate"), DMY=engine["DMY"].format("o_orderdate")
    )


def duck(template: str) -> str:
    return _words(template, _DUCK)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, template: str, source: str) -> DataFrame:
    """The view over one given table, which the template names after FROM."""
    sql = _words(template, _SPARK).replace('"table"', "`table`").replace('"column"', "`column`")
    sql = sql.replace("{", "{{").replace("}", "}}").replace(f"FROM {source}", "FROM {source}")
    return spark.sql(sql, source=table(spark, sf_dir, source))


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, DIRTY_ORDERS, "orders")


WITH_DIRTY = f"WITH dirty AS ({duck(DIRTY_ORDERS)})"
