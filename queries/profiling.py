"""Queries of the profile: counts, statistics, types, flags, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries.tables import WITH_DIRTY, dirty_orders, table
from tablecare import profile
from tablecare.operators.frequency import infer_frequency
from tablecare.operators.histogram import column_value_counts
from tablecare.operators.profile import distinct_counts, duplicate_count, null_report, numeric_stats
from tablecare.operators.samples import sample_rows

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
DIRTY_COLUMNS = ["o_orderkey", "amount", "cust_txt", "mixed_txt", "priority", "status", "date_txt", "note",
                 "answer", "constant_col"]
DIRTY_TEXTS = DIRTY_COLUMNS[2:]
ORDER_NUMBERS = ["o_custkey", "o_totalprice"]
LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINE_NUMBERS = LINE_COLUMNS[1:8]


def duck_date(c: str) -> str:
    """A text date by ISO, month-first, day-first, in this order."""
    return (
        f"coalesce(CASE WHEN regexp_matches(trim({c}), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_strptime(trim({c}), '%Y-%m-%d') END, "
        f"CASE WHEN regexp_matches(trim({c}), '^\\d{{2}}/\\d{{2}}/\\d{{4}}$') THEN try_strptime(trim({c}), '%m/%d/%Y') END, "
        f"CASE WHEN regexp_matches(trim({c}), '^\\d{{2}}/\\d{{2}}/\\d{{4}}$') THEN try_strptime(trim({c}), '%d/%m/%Y') END)"
    )


def duck_number(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '{NUMBER}') THEN TRY_CAST(trim({c}) AS DOUBLE) END"


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _number_stats(source: str, columns: list[str]) -> str:
    return _union([
        f"""SELECT '{c}' AS "column", round(min({c}), 4)::DOUBLE AS "min", round(max({c}), 4)::DOUBLE AS "max",
        round(avg({c}), 4) AS mean, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median,
        round(stddev_samp({c}), 4) AS std, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q1,
        round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q3, round(skewness({c}), 6) AS skewness FROM {source}"""
        for c in columns
    ])


def _rounded(stats: DataFrame) -> DataFrame:
    return stats.select("column", *[F.round(c, 4).alias(c) for c in ("min", "max", "mean")],
                        F.round("median", 6).alias("median"), F.round("std", 4).alias("std"),
                        *[F.round(c, 6).alias(c) for c in ("q1", "q3", "skewness")])


def numeric_stats_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile(table(spark, sf_dir, "orders")).numeric)


def numeric_stats_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(numeric_stats(table(spark, sf_dir, "lineitem"), LINE_NUMBERS))


def null_report_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return null_report(dirty_orders(spark, sf_dir)).withColumn("null_pct", F.round("null_pct", 6))


def some_twice(df: DataFrame, key: str) -> DataFrame:
    """The table, with the rows of every fiftieth key once more."""
    return df.unionByName(df.where(f"{key} % 50 = 0"))


def duplicates_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_count(some_twice(table(spark, sf_dir, "lineitem"), "l_orderkey"))


def duplicates_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_count(some_twice(table(spark, sf_dir, "documents"), "doc_id"))


def profile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = profile(dirty_orders(spark, sf_dir).drop("o_orderkey"))
    return result.summary.withColumn("completeness", F.round("completeness", 4))


def distinct_counts_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = distinct_counts(table(spark, sf_dir, "lineitem"))
    return counts.select("column", "distinct", F.round("cardinality_ratio", 8).alias("cardinality_ratio"))


def value_histogram_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_value_counts(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])


def categorical_stats_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = profile(dirty_orders(spark, sf_dir))
    return result.categorical.withColumn("cardinality_ratio", F.round("cardinality_ratio", 8))


def top_values_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(dirty_orders(spark, sf_dir)).top_values.withColumn("rank", F.col("rank").cast("bigint"))


def top_values_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text", "lang", "source")
    result = profile(docs)
    return (
        result.top.join(result.stats.select("pos", "column"), "pos")
        .select("column", "n", F.md5("value").alias("value_md5"))
    )


def datetime_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = profile(dirty_orders(spark, sf_dir).select("date_txt"))
    lines = profile(table(spark, sf_dir, "lineitem").select("l_shipdate"))
    events = profile(table(spark, sf_dir, "events").select("ts"))
    return dirty.datetime.unionByName(lines.datetime).unionByName(events.datetime).select(
        "column", "min_date", "max_date"
    )


# series name -> (table, Spark expression, DuckDB expression) of the distinct moments in it
_SERIES = {
    "hours": ("events", "date_trunc('hour', ts)", "date_trunc('hour', ts)"),
    "days": ("events", "date_trunc('day', ts)", "date_trunc('day', ts)"),
    "weeks": ("orders", "date_trunc('week', o_orderdate)", "date_trunc('week', o_orderdate)"),
    "month_starts": ("orders", "date_trunc('month', o_orderdate)", "date_trunc('month', o_orderdate)"),
    "month_ends": ("orders", "CAST(last_day(o_orderdate) AS TIMESTAMP)", "CAST(last_day(o_orderdate) AS TIMESTAMP)"),
    "quarter_starts": ("orders", "date_trunc('quarter', o_orderdate)", "date_trunc('quarter', o_orderdate)"),
    "year_starts": ("orders", "date_trunc('year', o_orderdate)", "date_trunc('year', o_orderdate)"),
    "working_days": ("events", "CASE WHEN weekday(ts) < 5 THEN date_trunc('day', ts) END",
                     "CASE WHEN isodow(ts) < 6 THEN date_trunc('day', ts) END"),
    "irregular": ("events", "ts", "ts"),
}


def inferred_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for name, (source, moment, _) in _SERIES.items():
        moments = table(spark, sf_dir, source).select(F.expr(moment).alias("t")).distinct()
        rows.append((name, infer_frequency(moments, {"t": F.col("t")})["t"]))
    return spark.createDataFrame(rows, "series string, frequency string")


_MONTHS = "['JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC']"
_FREQUENCY_SQL = _union([
    f"""SELECT '{name}' AS series, (
    WITH m AS (SELECT DISTINCT t FROM (SELECT {moment} AS t FROM {source}) WHERE t IS NOT NULL),
    g AS (SELECT t, lag(t) OVER (ORDER BY t) AS p FROM m),
    s AS (SELECT count(*) AS n, min(t) AS lo, max(t) AS hi,
          count(DISTINCT epoch_us(t) - epoch_us(p)) AS gaps, min(epoch_us(t) - epoch_us(p)) AS gap,
          count(DISTINCT (year(t) * 12 + month(t)) - (year(p) * 12 + month(p))) AS month_gaps,
          min((year(t) * 12 + month(t)) - (year(p) * 12 + month(p))) AS month_gap,
          bool_and(day(t) = 1) AS starts, bool_and(t = CAST(last_day(t) AS TIMESTAMP)) AS ends,
          bool_and(isodow(t) < 6 AND t = date_trunc('day', t)) AS workdays,
          bool_and(p IS NULL OR datediff('day', p, t) = CASE WHEN isodow(t) = 1 THEN 3 ELSE 1 END) AS next_workday
          FROM g)
    SELECT CASE
      WHEN n < 4 THEN NULL
      WHEN month_gaps = 1 AND month_gap % 12 = 0 AND month_gap > 0 AND (starts OR ends) THEN
        CASE WHEN month_gap > 12 THEN CAST(month_gap // 12 AS VARCHAR) ELSE '' END
        || CASE WHEN starts THEN 'YS-' ELSE 'YE-' END || {_MONTHS}[month(lo)]
      WHEN month_gaps = 1 AND month_gap % 3 = 0 AND month_gap > 0 AND (starts OR ends) THEN
        CASE WHEN month_gap > 3 THEN CAST(month_gap // 3 AS VARCHAR) ELSE '' END
        || CASE WHEN starts THEN 'QS-' ELSE 'QE-' END || {_MONTHS}[(month(lo) - 1) % 3 + 10]
      WHEN month_gaps = 1 AND month_gap > 0 AND (starts OR ends) THEN
        CASE WHEN month_gap > 1 THEN CAST(month_gap AS VARCHAR) ELSE '' END || CASE WHEN starts THEN 'MS' ELSE 'ME' END
      WHEN gaps = 1 AND gap = 604800000000 THEN 'W-' || upper(left(dayname(hi), 3))
      WHEN gaps = 1 AND gap = 86400000000 THEN 'D'
      WHEN gaps = 1 AND gap = 3600000000 THEN 'h'
      WHEN workdays AND next_workday THEN 'B' END FROM s) AS frequency"""
    for name, (source, _, moment) in _SERIES.items()
])


def parse_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = profile(dirty_orders(spark, sf_dir)).stats.where("kind = 'text'")
    return stats.select("column", F.round("number_share", 6).alias("number_share"),
                        F.round("date_share", 6).alias("date_share"))


def column_breakdown_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = profile(dirty_orders(spark, sf_dir)).columns
    return columns.select("column", "semantic_type", F.round("null_pct", 6).alias("null_pct"), "flagged")


def semantic_types_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of the columns of documents, labels, part and customer."""
    parts = [profile(table(spark, sf_dir, t)).columns.select("column", "semantic_type")
             for t in ("documents", "labels", "part", "customer")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def semantic_types_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = profile(table(spark, sf_dir, "embeddings").select("embedding"))
    return result.stats.select("column", "semantic_type", "null_count", "distinct")


def quality_flags_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = profile(dirty_orders(spark, sf_dir)).flags
    return flags.select("column", "flag", F.round("measure", 6).alias("measure"))


def sample_rows_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sample_rows(table(spark, sf_dir, "orders"), order_by=["o_orderkey"], seed=7)
    return rows.select("section", F.col("rank").cast("bigint").alias("rank"), "o_orderkey", "o_totalprice")


def approximate_profile_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of the one-scan profile that are exact all the same."""
    stats = profile(table(spark, sf_dir, "lineitem"), approx=True).stats
    return stats.where("kind IN ('integer', 'fraction')").select(
        "column", "non_null", "whole", F.round("min", 4).alias("min"), F.round("max", 4).alias("max"),
        F.round("mean", 4).alias("mean")
    )


def _type_case(text: bool) -> str:
    return """CASE WHEN non_null = 0 THEN 'unknown' WHEN words AND lowered <= 2 THEN 'boolean'
      WHEN dates / non_null > 0.5 THEN 'datetime'
      WHEN named AND dist / non_null > 0.5 THEN 'identifier' WHEN dist / non_null > 0.95 THEN 'identifier'
      WHEN len > 50 THEN 'text' ELSE 'categorical' END""" if text else """CASE
      WHEN whole_type AND dist / n > 0.95 THEN 'identifier'
      WHEN whole AND dist <= greatest(20, floor(n * 0.05)) THEN 'numeric-discrete' ELSE 'numeric-continuous' END"""


_BOOLEAN_WORDS = "('true', 'false', 'yes', 'no', 'y', 'n', 't', 'f')"
_ID_NAME = "(^id$|_id$|^id_|uuid|_key$|^key$)"


def _text_facts(source: str, columns: list[str]) -> str:
    return _union([
        f"""SELECT '{c}' AS "column", count(*) AS n, count({c}) AS non_null, count(DISTINCT {c}) AS dist,
        count({duck_number(c)}) AS numbers, count({duck_date(c)}) AS dates,
        bool_and(lower({c}) IN {_BOOLEAN_WORDS}) AS words, count(DISTINCT lower({c})) AS lowered,
        regexp_matches('{c}', '{_ID_NAME}', 'i') AS named, avg(length({c})) AS len,
        bool_or({c} <> trim({c}, chr(9) || chr(10) || chr(13) || ' ')) AS padded FROM {source}""" for c in columns
    ])


def _number_facts(source: str, columns: list[tuple[str, bool]]) -> str:
    return _union([
        f"""SELECT '{c}' AS "column", count(*) AS n, count({c}) AS non_null, count(DISTINCT {c}) AS dist,
        bool_and({c} = floor({c})) AS whole, {whole} AS whole_type FROM {source}""" for c, whole in columns
    ])


_DIRTY_NUMBERS = [("o_orderkey", True), ("amount", False)]
_WITH_FACTS = (
    f"{WITH_DIRTY}, facts AS ({_text_facts('dirty', DIRTY_TEXTS)}), "
    f"numbers AS ({_number_facts('dirty', _DIRTY_NUMBERS)})"
)
_FLAGS = """SELECT "column", 'high_nulls' AS flag, round(1 - non_null / n, 6) AS measure FROM every WHERE 1 - non_null / n > 0.9
UNION ALL SELECT "column", 'constant_column', dist FROM every WHERE non_null > 0 AND dist <= 1
UNION ALL SELECT "column", 'potential_id', round(dist / non_null, 6) FROM every
  WHERE dist > 1 AND ((named AND dist / non_null > 0.5) OR dist / non_null > 0.95)
UNION ALL SELECT "column", 'high_cardinality', round(dist / non_null, 6) FROM every
  WHERE dist > 1 AND NOT ((named AND dist / non_null > 0.5) OR dist / non_null > 0.95) AND dist / non_null > 0.5
UNION ALL SELECT "column", 'whitespace_issues', NULL FROM facts WHERE dist > 1 AND padded
UNION ALL SELECT "column", 'looks_numeric', round(numbers / non_null, 6) FROM facts WHERE dist > 1 AND numbers / non_null >= 0.8
UNION ALL SELECT "column", 'mixed_types', round(numbers / non_null, 6) FROM facts
  WHERE dist > 1 AND numbers / non_null >= 0.1 AND numbers / non_null < 0.8
UNION ALL SELECT "column", 'looks_datetime', round(dates / non_null, 6) FROM facts
  WHERE dist > 1 AND numbers / non_null < 0.1 AND dates / non_null >= 0.7"""
_EVERY = f"""every AS (SELECT "column", n, non_null, dist, named FROM facts
  UNION ALL SELECT "column", n, non_null, dist, regexp_matches("column", '{_ID_NAME}', 'i') FROM numbers)"""
_NOT_KEY = ", ".join(DIRTY_COLUMNS[1:])


def _type_table(name: str, texts: list[str], numbers: list[tuple[str, bool]]) -> str:
    return _union(
        [f"""SELECT "column", {_type_case(True)} AS semantic_type FROM ({_text_facts(name, texts)})"""] * bool(texts)
        + [f"""SELECT "column", {_type_case(False)} AS semantic_type FROM ({_number_facts(name, numbers)})"""]
    )


QUERIES = {
    "profile_numeric_stats_orders": (numeric_stats_orders, _number_stats("orders", ORDER_NUMBERS)),
    "profile_numeric_stats_lineitem": (numeric_stats_lineitem, _number_stats("lineitem", LINE_NUMBERS)),
    "profile_null_report": (null_report_dirty, WITH_DIRTY + _union([
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS null_count,
        round(1 - count({c}) / count(*), 6) AS null_pct, (1 - count({c}) / count(*)) > 0.9 AS flagged FROM dirty"""
        for c in DIRTY_COLUMNS])),
    "profile_duplicates_lineitem": (duplicates_lineitem, """WITH r AS (FROM lineitem UNION ALL FROM lineitem WHERE l_orderkey % 50 = 0)
        SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM r)) AS duplicate_count FROM r"""),
    "profile_duplicates_documents": (duplicates_documents, """WITH r AS (FROM documents UNION ALL FROM documents WHERE doc_id % 50 = 0)
        SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM r)) AS duplicate_count FROM r"""),
    "profile_summary": (profile_summary, f"""{_WITH_FACTS.replace(f"numbers AS ({_number_facts('dirty', _DIRTY_NUMBERS)})",
        f"numbers AS ({_number_facts('dirty', [('amount', False)])})")}, {_EVERY}, flags AS ({_FLAGS})
        SELECT count(*) AS row_count, {len(DIRTY_COLUMNS) - 1}::BIGINT AS column_count,
        round((SELECT (1 - sum(n - non_null) / sum(n)) * 100 FROM every), 4) AS completeness,
        (SELECT count(*) FROM flags) AS flag_count,
        count(*) - (SELECT count(*) FROM (SELECT DISTINCT {_NOT_KEY} FROM dirty)) AS duplicate_count FROM dirty"""),
    "profile_distinct_counts": (distinct_counts_lineitem, _union([
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS "distinct",
        round(count(DISTINCT {c}) / count({c}), 8) AS cardinality_ratio FROM lineitem""" for c in LINE_COLUMNS])),
    "profile_value_histogram": (value_histogram_orders, _union([
        f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS "value", count(*) AS n FROM orders GROUP BY {c}"""
        for c in ("o_orderstatus", "o_orderpriority", "o_custkey")])),
    "profile_categorical_stats": (categorical_stats_dirty, f"""{_WITH_FACTS},
        shown AS (SELECT "column", dist, non_null FROM facts WHERE {_type_case(True)} <> 'datetime'
        UNION ALL SELECT "column", dist, non_null FROM numbers WHERE {_type_case(False)} = 'identifier')
        SELECT "column", dist AS unique_count, round(dist / non_null, 8) AS cardinality_ratio FROM shown"""),
    "profile_top_values": (top_values_dirty, f"""{_WITH_FACTS}, counts AS ({_union([
        f'''SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS "value", count(*) AS n,
        row_number() OVER (ORDER BY count(*) DESC, {c}) AS "rank" FROM dirty WHERE {c} IS NOT NULL GROUP BY {c}'''
        for c in DIRTY_COLUMNS if c not in ("amount", "date_txt")])})
        SELECT "column", "rank", "value", n FROM counts WHERE "rank" <= 5"""),
    "profile_top_values_long_texts": (top_values_documents, f"""WITH counts AS ({_union([
        f'''SELECT '{c}' AS "column", {c} AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC,
        CASE WHEN octet_length(encode({c})) <= 64 THEN {c} ELSE '#' || sha256({c}) END) AS r FROM documents GROUP BY {c}'''
        for c in ("text", "lang", "source")])}) SELECT "column", n, md5(v) AS value_md5 FROM counts WHERE r <= 5"""),
    "profile_datetime_stats": (datetime_stats, f"""{WITH_DIRTY}
        SELECT 'date_txt' AS "column", strftime(min({duck_date('date_txt')}), '%Y-%m-%dT%H:%M:%S') AS min_date,
        strftime(max({duck_date('date_txt')}), '%Y-%m-%dT%H:%M:%S') AS max_date FROM dirty
        UNION ALL SELECT 'l_shipdate', strftime(min(l_shipdate), '%Y-%m-%dT%H:%M:%S'),
        strftime(max(l_shipdate), '%Y-%m-%dT%H:%M:%S') FROM lineitem
        UNION ALL SELECT 'ts', strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f'), strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') FROM events"""),
    "profile_inferred_frequency": (inferred_frequency, _FREQUENCY_SQL),
    "profile_parse_shares": (parse_shares, f"""{_WITH_FACTS} SELECT "column", round(numbers / non_null, 6) AS number_share,
        round(dates / non_null, 6) AS date_share FROM facts"""),
    "profile_column_breakdown": (column_breakdown_dirty, f"""{_WITH_FACTS}
        SELECT "column", {_type_case(True)} AS semantic_type, round(1 - non_null / n, 6) AS null_pct,
        (1 - non_null / n) > 0.9 AS flagged FROM facts
        UNION ALL SELECT "column", {_type_case(False)}, round(1 - non_null / n, 6), (1 - non_null / n) > 0.9 FROM numbers"""),
    "profile_semantic_types": (semantic_types_tables, _union([
        _type_table("documents", ["text", "lang", "source"], [("doc_id", True), ("n_chars", True)]),
        _type_table("labels", [], [("doc_id", True), ("quality", True), ("toxic", True)]),
        _type_table("part", ["p_name", "p_brand", "p_type"], [("p_partkey", True), ("p_size", True), ("p_retailprice", False)]),
        _type_table("customer", ["c_name", "c_mktsegment"], [("c_custkey", True), ("c_nationkey", True), ("c_acctbal", False)]),
    ])),
    "profile_nested_column": (semantic_types_nested, """SELECT 'embedding' AS "column", 'unknown' AS semantic_type,
        count(*) - count(embedding) AS null_count, count(DISTINCT embedding) AS "distinct" FROM embeddings"""),
    "profile_quality_flags": (quality_flags_dirty, f"{_WITH_FACTS}, {_EVERY} {_FLAGS}"),
    "profile_sample_rows": (sample_rows_orders, """WITH r AS (SELECT o_orderkey, o_totalprice,
        row_number() OVER (ORDER BY o_orderkey) AS a, row_number() OVER (ORDER BY o_orderkey DESC) AS z,
        row_number() OVER (ORDER BY md5('7|' || CAST(o_orderkey AS VARCHAR))) AS m FROM orders)
        SELECT 'first' AS section, a AS "rank", o_orderkey, o_totalprice FROM r WHERE a <= 5
        UNION ALL SELECT 'last', z, o_orderkey, o_totalprice FROM r WHERE z <= 5
        UNION ALL SELECT 'random', m, o_orderkey, o_totalprice FROM r WHERE m <= 5"""),
    "profile_one_scan_lineitem": (approximate_profile_lineitem, _union([
        f"""SELECT '{c}' AS "column", count({c}) AS non_null, bool_and({c} = floor({c})) AS whole,
        round(min({c}), 4)::DOUBLE AS "min", round(max({c}), 4)::DOUBLE AS "max", round(avg({c}), 4) AS mean FROM lineitem"""
        for c in LINE_COLUMNS[:8]])),
}
