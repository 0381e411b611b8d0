"""Queries of the cases that everyday tables bring: failing expressions, odd names, NaN, maps, date shapes, arrays of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries.tables import WITH_DIRTY, dirty_orders, table
from tablecare.functions.dates import parse_timestamp
from tablecare.operators.clean import Dedupe, Derive, DropMissing, Fill, Head, MapLabels, Strip, ToNumber, Where
from tablecare.operators.kpi import Kpi, kpis, screen_kpis
from tablecare.operators.profile import duplicate_count
from tablecare.plans.plan import Plan
from tablecare.scratch import new_path
from tablecare.sources import read_json


def kpi_failing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zero divisor, a bad cast and a bad array index are null for their KPI alone; a plain median is exact."""
    wanted = [
        Kpi("revenue", "sum(o_totalprice)"), Kpi("no divisor", "sum(o_totalprice) / count_if(false)"), Kpi("no number", "avg(CAST(o_orderstatus AS INT))"),
        Kpi("no such place", "max(array(o_totalprice)[3])"), Kpi("no such column", "sum(nowhere)"), Kpi("held", "collect_list(o_custkey)[0]"), Kpi("middle", "median(o_totalprice)"),
    ]
    return kpis(table(spark, sf_dir, "orders"), wanted).select("position", "kpi", F.round("value", 2).alias("value"))


def kpi_screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    kept = screen_kpis(orders, [Kpi("a", "sum(o_totalprice)"), Kpi("b", "sum(nowhere)"), Kpi("c", "count(*)"), Kpi("d", "mode(o_custkey)")])
    return kpis(orders, kept).select("kpi", F.round("value", 2).alias("value"))


_STEPS = Plan([
    Derive("as_number", "CAST(o_orderstatus AS INT)", id="cast"), Derive("share", "o_totalprice / (o_custkey - o_custkey)", id="zero"),
    Derive("third", "split(o_orderpriority, '-')[5]", id="place"), Derive("gone", "nowhere + 1", id="gone"), Where("o_totalprice / 0 IS NULL", id="where"),
    Derive("half", "o_totalprice / 2", id="half"),
])


def plan_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps whose SQL fails on values give null; the step that names no column of the table is skipped."""
    return _STEPS.apply(table(spark, sf_dir, "orders"))[0].select("o_orderkey", "as_number", "share", "third", "half")


def _log_beside_table(plan: Plan, orders: DataFrame, only_ids: list[str] | None = None) -> DataFrame:
    """The log, and beside each step the rows and halves that the finished table has."""
    rows, log = plan.apply(orders, only_ids)
    told = rows.agg(F.count("*").alias("n"), F.round(F.sum("half"), 1).alias("halves"))
    return log.select("id", "status", told.select("n").scalar().alias("n"), told.select("halves").scalar().alias("halves"))


def plan_lenient_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log_beside_table(_STEPS, table(spark, sf_dir, "orders"))


def plan_screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that name what the table lacks are dropped before the run, and only chosen ones run."""
    orders = table(spark, sf_dir, "orders")
    return _log_beside_table(_STEPS.screen(orders.columns), orders, ["half", "gone"])


_NAMES = Plan([
    Where("year > 2000", id="no such column"), Derive("day", "o_orderkey % 7", id="makes one called day"), Where("day < 5", id="reads it, not yet there"),
    Derive("late", "exists(array(o_custkey, o_orderkey), year -> year > 700)", id="bound"), Derive("when", "date_add(current_date, 0) IS NOT NULL AND o_orderstatus <> 'year'", id="words in texts"),
    Where("exists(array(1), x -> x + amount > 0)", id="free in a lambda"), Derive("first", "s.year + 1", id="field of a struct"), Derive("none", "t.year", id="no such struct"),
])


def plan_screened_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which steps the parser's names leave, and the rows that they give."""
    orders = table(spark, sf_dir, "orders").withColumn("s", F.struct(F.col("o_custkey").alias("year")))
    return _NAMES.screen(orders.columns).apply(orders)[0].drop("s")


_COUNTED = Plan([
    Strip(["priority"], id="strip"), ToNumber(["cust_txt"], id="number"), Fill(["amount"], how="median", id="fill"), Derive("none", "nowhere + 1", id="none"),
    DropMissing(["status"], id="drop"), Where("o_orderkey % 5 > 0", id="where"), Dedupe(["cust_txt"], ["o_orderkey"], id="first"), Head(n=10, order_by=["o_orderkey"], id="head"),
])


def plan_log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each step did to the rows of dirty orders, counted while the cleaned table is read."""
    rows, counts = _COUNTED.observed(dirty_orders(spark, sf_dir))
    rows.write.parquet(new_path(spark, "counted"))
    return counts.frame().select("id", "status", "rows_in", "rows_out", "changed")


def map_labels_beside_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent spelling in a table that has a column ``label`` of its own."""
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "label", "CASE WHEN vec_id % 5 = 0 THEN upper(concat('kind ', label)) ELSE concat('kind ', label) END AS name")
    return MapLabels("name").apply(rows)


#: Spark's and DuckDB's patterns of one shape, and the unit that the shape keeps.
_SHAPES = [
    ("yyyy-MM-dd", "%Y-%m-%d", "day"), ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S", "second"), ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "%Y-%m-%dT%H:%M:%S.%f", "microsecond"),
    ("yyyy-MM-dd HH:mm", "%Y-%m-%d %H:%M", "minute"), ("yyyy/MM/dd", "%Y/%m/%d", "day"), ("MM-dd-yyyy", "%m-%d-%Y", "day"), ("d MMM yyyy", "%-d %b %Y", "day"),
    ("MMM d, yyyy", "%b %-d, %Y", "day"), ("yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ", "second"), ("yyyy-MM-dd'T'HH:mm:ss'+02:00'", "%Y-%m-%dT%H:%M:%S+02:00", "second"),
]


def date_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times written in ten shapes and read back."""
    shape = F.col("event_id") % len(_SHAPES)
    written = F.coalesce(*(F.when(shape == i, F.date_format("ts", spark_shape)) for i, (spark_shape, _, _) in enumerate(_SHAPES)))
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(parse_timestamp(written)).alias("micros"))


def duplicates_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth order twice, once with NaN and once without a price: equal, as both are missing."""
    orders = table(spark, sf_dir, "orders")
    some = orders.where("o_orderkey % 50 = 0")
    both = orders.where("o_orderkey % 50 <> 0").unionByName(some.withColumn("o_totalprice", F.lit(float("nan")))).unionByName(some.withColumn("o_totalprice", F.lit(None).cast("double")))
    left = Dedupe().apply(both).agg(F.count("*").alias("rows_left"))
    return duplicate_count(both).crossJoin(left)  # one row beside one row


def duplicates_of_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal maps whose entries come in another order are equal rows."""
    rows = table(spark, sf_dir, "events").selectExpr("user_id", "IF(event_id % 2 = 0, map('a', user_id, 'b', 1L), map('b', 1L, 'a', user_id)) AS m")
    return duplicate_count(rows)


def dotted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "IF(o_orderkey % 3 = 0, NULL, o_custkey) AS `cust.key`")
    return DropMissing(["cust.key"]).apply(rows).select("o_orderkey", F.col("`cust.key`").alias("cust_key"))


#: Objects of one written array, on average.
_ARRAY = 1_000_000


def json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as arrays of objects, one a file; files are as many as the rows ask for, and none is held as a whole."""
    path = new_path(spark, "customers-json")
    customers = table(spark, sf_dir, "customer")
    files = max(1, -(-customers.count() // _ARRAY))
    item = F.to_json(F.struct("c_custkey", "c_name", "c_acctbal"))
    rows = customers.select(F.pmod(F.xxhash64("c_custkey"), F.lit(files)).alias("file"), F.col("c_custkey").alias("key"), item.alias("item"))
    ends = rows.groupBy("file").agg(F.min("key").alias("first"))
    opened = rows.join(F.broadcast(ends), "file").select("file", "key", F.concat(F.when(F.col("key") == F.col("first"), F.lit("[")).otherwise(F.lit(",")), "item").alias("value"))
    closed = ends.select("file", F.lit(None).cast("bigint").alias("key"), F.lit("]").alias("value"))
    lines = opened.unionByName(closed).repartition("file").sortWithinPartitions("file", F.asc_nulls_last("key"))
    lines.select("file", "value").write.partitionBy("file").text(path)
    found, rejects = read_json(spark, path, schema="c_custkey bigint, c_name string, c_acctbal double")
    return found.select("c_custkey", "c_name", "c_acctbal").unionByName(rejects.selectExpr("CAST(NULL AS bigint) AS c_custkey", "line AS c_name", "CAST(NULL AS double) AS c_acctbal"))


_DUCK_SHAPES = " ".join(
    f"WHEN {i} THEN epoch_us(date_trunc('{unit}', ts)){' - 7200000000' if '+02' in duck else ''}" for i, (_, duck, unit) in enumerate(_SHAPES))

_HALVES = "(SELECT count(*) AS n, round(sum(o_totalprice / 2), 1) AS halves FROM orders) h"

QUERIES = {
    "kpi_failing": (kpi_failing, """SELECT 0 AS position, 'revenue' AS kpi, round(sum(o_totalprice), 2) AS "value" FROM orders
        UNION ALL SELECT 1, 'no divisor', NULL UNION ALL SELECT 2, 'no number', NULL UNION ALL SELECT 3, 'no such place', NULL
        UNION ALL SELECT 4, 'no such column', NULL UNION ALL SELECT 5, 'held', NULL UNION ALL SELECT 6, 'middle', round(quantile_cont(o_totalprice, 0.5), 2) FROM orders"""),
    "kpi_screened": (kpi_screened, """SELECT 'a' AS kpi, round(sum(o_totalprice), 2) AS "value" FROM orders UNION ALL SELECT 'c', count(*) FROM orders"""),
    "plan_lenient": (plan_lenient, """SELECT o_orderkey, NULL::INT AS as_number, NULL::DOUBLE AS share, NULL::VARCHAR AS third, o_totalprice / 2 AS half FROM orders"""),
    "plan_lenient_log": (plan_lenient_log, f"""SELECT * FROM (VALUES ('cast', 'ok'), ('zero', 'ok'), ('place', 'ok'), ('gone', 'skip'), ('where', 'ok'), ('half', 'ok')) t(id, status), {_HALVES}"""),
    "plan_screened": (plan_screened, f"SELECT 'half' AS id, 'ok' AS status, * FROM {_HALVES}"),
    "plan_log_counts": (plan_log_counts, f"""{WITH_DIRTY}, a AS (SELECT count(*) AS n, count(*) FILTER (priority <> trim(priority)) AS padded, count(*) FILTER (cust_txt = 'abc') AS words,
        count(*) FILTER (amount IS NULL) AS gaps, count(status) AS kept, count(status) FILTER (o_orderkey % 5 > 0) AS few, count(DISTINCT CASE WHEN status IS NOT NULL AND o_orderkey % 5 > 0 THEN cust_txt END) AS first FROM dirty)
        SELECT 'strip' AS id, 'ok' AS status, n AS rows_in, n AS rows_out, padded AS changed FROM a UNION ALL SELECT 'number', 'ok', n, n, words FROM a UNION ALL SELECT 'fill', 'ok', n, n, gaps FROM a
        UNION ALL SELECT 'none', 'skip', n, n, 0 FROM a UNION ALL SELECT 'drop', 'ok', n, kept, 0 FROM a UNION ALL SELECT 'where', 'ok', kept, few, 0 FROM a
        UNION ALL SELECT 'first', 'ok', few, first, NULL FROM a UNION ALL SELECT 'head', 'ok', first, least(first, 10), NULL FROM a"""),
    "plan_screened_names": (plan_screened_names, """SELECT *, o_orderkey % 7 AS day, o_custkey > 700 OR o_orderkey > 700 AS late, o_orderstatus <> 'year' AS "when", o_custkey + 1 AS first FROM orders"""),
    "clean_map_labels_embeddings": (map_labels_beside_label, """WITH r AS (SELECT vec_id, label, CASE WHEN vec_id % 5 = 0 THEN upper(concat('kind ', label)) ELSE concat('kind ', label) END AS name FROM embeddings),
        n AS (SELECT lower(name) AS k, name AS best, row_number() OVER (PARTITION BY lower(name) ORDER BY count(*) DESC, name) AS r FROM r GROUP BY name)
        SELECT vec_id, label, best AS name FROM r JOIN n ON lower(r.name) = n.k AND n.r = 1"""),
    "clean_to_timestamp_shapes": (date_shapes, f"SELECT event_id, CASE event_id % {len(_SHAPES)} {_DUCK_SHAPES} END AS micros FROM events"),
    "profile_duplicates_missing": (duplicates_missing, """SELECT count(*) FILTER (o_orderkey % 50 = 0) AS duplicate_count, count(*) AS rows_left FROM orders"""),
    "profile_duplicates_maps": (duplicates_of_maps, "SELECT count(*) - count(DISTINCT user_id) AS duplicate_count FROM events"),
    "clean_drop_missing_dotted": (dotted_names, "SELECT o_orderkey, o_custkey AS cust_key FROM orders WHERE o_orderkey % 3 <> 0"),
    "source_json_arrays": (json_arrays, "SELECT c_custkey, c_name, c_acctbal FROM customer"),
}
