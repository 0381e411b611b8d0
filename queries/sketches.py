"""Queries of profiles that are kept as tables of sketches and merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries.tables import WITH_DIRTY, dirty_orders, table
from tablecare.operators.sketches import RANK_ERROR, TOP_ITEMS, merge_profiles, profile_figures, sketch_profile, store_profile, stored_profile
from tablecare.scratch import new_path

_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def merged_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items loaded in four parts, each profiled by itself and stored; what the merged profile says exactly."""
    lines = table(spark, sf_dir, "lineitem")
    path = new_path(spark, "profile")
    for part in range(4):
        store_profile(lines.where(F.col("l_orderkey") % 4 == part).select(*_NUMBERS), path, str(part))
    # the last load comes again, corrected: it replaces its part
    store_profile(lines.where("l_orderkey % 4 = 3").select(*_NUMBERS), path, "3")
    found = profile_figures(merge_profiles(stored_profile(spark, path)))
    return found.select("column", "rows", "non_null", F.round("min", 4).alias("min"), F.round("max", 4).alias("max"),
                        *[F.round(c, 4).alias(c) for c in ("mean", "std", "skewness")])


def merged_dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and nulls by load: shares, lengths and padding of two merged halves."""
    rows = dirty_orders(spark, sf_dir)
    parts = sketch_profile(rows, (F.col("o_orderkey") % 2).cast("string"))
    found = profile_figures(merge_profiles(parts)).where("kind = 'text'")
    return found.select("column", "rows", "non_null", F.round("null_share", 6).alias("null_share"), F.round("number_share", 6).alias("number_share"),
                        F.round("mean_length", 6).alias("mean_length"), "padded")


def merged_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do the sketches of three merged loads keep their bounds? Estimates beside exact figures of the whole."""
    lines = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_partkey", "l_quantity")
    parts = sketch_profile(lines.withColumn("load", (F.col("l_partkey") % 3).cast("string")), F.col("load")).where("column != 'load'")
    found = profile_figures(merge_profiles(parts), top=3)
    cells = lines.select(F.posexplode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in lines.columns]))).select("col.*")
    counted = cells.groupBy("column", "value").agg(F.count("*").alias("n"))
    joined = counted.join(F.broadcast(found.select("column", "distinct", "q1", "median", "q3", "non_null", "top")), "column")
    below = [F.sum(F.when(F.col("value") <= F.col(q), F.col("n"))).alias(f"upto_{q}") for q in ("q1", "median", "q3")]
    below += [F.sum(F.when(F.col("value") < F.col(q), F.col("n")).otherwise(0)).alias(f"under_{q}") for q in ("q1", "median", "q3")]
    listed = F.expr("get(filter(top, t -> CAST(t.value AS double) = value), 0).n")
    off = F.max(F.abs(listed - F.col("n")))
    exact = joined.groupBy("column", "distinct", "non_null").agg(F.count("*").alias("kinds"), off.alias("off"), *below)
    n = F.col("non_null")

    def near(name: str, share: float):
        # the rank of a value that occurs often is a range
        return (F.col(f"under_{name}") / n <= share + RANK_ERROR) & (F.col(f"upto_{name}") / n >= share - RANK_ERROR)

    return exact.select("column", (F.abs(F.col("distinct") / F.col("kinds") - 1) <= 4 * 0.01625).alias("distinct_ok"),
                        (near("q1", 0.25) & near("median", 0.5) & near("q3", 0.75)).alias("ranks_ok"),
                        (F.coalesce("off", F.lit(0)) <= 3.5 / TOP_ITEMS * n).alias("top_ok"))


_EXACT = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS "rows", count({c}) AS non_null, round(min({c}), 4)::DOUBLE AS "min", round(max({c}), 4)::DOUBLE AS "max",
        round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(skewness({c}), 4) AS skewness FROM lineitem""" for c in _NUMBERS)
_TEXTS = ("cust_txt", "mixed_txt", "priority", "status", "date_txt", "note", "answer", "constant_col")


def _dirty() -> str:
    number = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"
    each = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS "rows", count({c}) AS non_null, round((count(*) - count({c})) / count(*), 6) AS null_share,
        round(count(*) FILTER (regexp_matches({c}, {number})) / count({c}), 6) AS number_share, round(avg(length({c})), 6) AS mean_length,
        bool_or({c} <> trim({c})) AS padded FROM dirty""" for c in _TEXTS)
    return f"{WITH_DIRTY} {each}"


QUERIES = {
    "profile_merged_lineitem": (merged_lineitem, _EXACT),
    "profile_merged_texts": (merged_dirty_orders, _dirty()),
    "profile_merged_bounds": (merged_bounds, " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", TRUE AS distinct_ok, TRUE AS ranks_ok, TRUE AS top_ok""" for c in ("l_extendedprice", "l_partkey", "l_quantity"))),
}
