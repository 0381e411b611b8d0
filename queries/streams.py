"""Queries of streams: files that land in several loads, with restarts between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries.tables import WITH_DIRTY, dirty_orders, table
from tablecare.operators.clean import Derive, Strip, ToNumber, ToTimestamp, Where
from tablecare.operators.sketches import merge_profiles, profile_figures, stored_profile
from tablecare.plans.plan import Plan
from tablecare.scratch import new_path
from tablecare.sources import write_csv
from tablecare.streaming.landing import Landing

_LOADS = 3
_PLAN = Plan([Strip(["priority"]), ToNumber(["amount"]), ToTimestamp(["date_txt"]), Derive("half", "amount / 2"), Where("amount > 100000")])


def _landed(spark: SparkSession, sf_dir: str, **options) -> Landing:
    """Dirty orders in three loads, each a run of its own that starts where the last one ended."""
    folder = new_path(spark, "landing")
    landing = Landing(folder, new_path(spark, "landed"), _PLAN, **options)
    rows = dirty_orders(spark, sf_dir).select("o_orderkey", "amount", "priority", "date_txt")
    for load in range(_LOADS):
        write_csv(rows.where(F.col("o_orderkey") % _LOADS == load), f"{folder}/load-{load}")
        landing.run(spark)
    landing.run(spark)  # nothing new
    return landing


def landed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _landed(spark, sf_dir).rows(spark).select(
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "amount", "priority", F.to_date("date_txt").alias("day"), F.round("half", 4).alias("half"))


def landed_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile kept beside the rows: parts of the loads, merged."""
    landing = _landed(spark, sf_dir, profile=True)
    found = profile_figures(merge_profiles(stored_profile(spark, f"{landing.target}/profile")))
    return found.where(F.col("column").isin("amount", "half")).select("column", "rows", "non_null", F.round("min", 4).alias("min"), F.round("max", 4).alias("max"), F.round("mean", 4).alias("mean"))


def landed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of two loads, with a line in ten that has a field too many: rows and rejects of each batch."""
    folder = new_path(spark, "landing")
    landing = Landing(folder, new_path(spark, "landed"), Plan([]))
    line = F.concat_ws(",", F.col("event_id").cast("string"), "event_type", F.when(F.col("user_id") % 10 == 0, F.lit("extra")))
    for load in range(2):
        lines = table(spark, sf_dir, "events").where(F.col("event_id") % 2 == load).select(line.alias("event_id,event_type"))
        lines.write.option("header", True).option("sep", "\t").csv(f"{folder}/load-{load}")
        landing.run(spark)
    return landing.log(spark).select("batch", "rows", "rejects")


_CLEAN = f"""{WITH_DIRTY}, clean AS (SELECT o_orderkey, amount, trim(priority) AS priority, coalesce(try_strptime(date_txt, '%Y-%m-%d'), try_strptime(date_txt, '%m/%d/%Y'),
    try_strptime(date_txt, '%d/%m/%Y'))::DATE AS day, round(amount / 2, 4) AS half FROM dirty WHERE amount > 100000)"""

QUERIES = {
    "stream_landing_rows": (landed_rows, f"{_CLEAN} SELECT * FROM clean"),
    "stream_landing_profile": (landed_profile, f"""{_CLEAN} SELECT 'amount' AS "column", count(*) AS "rows", count(amount) AS non_null, round(min(amount), 4) AS "min", round(max(amount), 4) AS "max",
        round(avg(amount), 4) AS mean FROM clean UNION ALL SELECT 'half', count(*), count(amount), round(min(amount / 2), 4), round(max(amount / 2), 4), round(avg(amount / 2), 4) FROM clean"""),
    "stream_landing_log": (landed_log, """SELECT (event_id % 2)::INT AS batch, count(*) FILTER (user_id % 10 <> 0) AS "rows", count(*) FILTER (user_id % 10 = 0) AS rejects FROM events GROUP BY 1"""),
}
