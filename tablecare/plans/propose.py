"""Propose cleaning steps from a profile: one rule per quality issue."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tablecare.functions.text import MISSING_LABELS, label_key
from tablecare.operators.clean import (
    Dedupe, DropMissing, Fill, MissingLabels, Op, SplitMixed, Strip, Title, ToNumber, ToTimestamp,
    label_spellings,
)
from tablecare.operators.histogram import column_value_counts
from tablecare.operators.profile import ProfileResult
from tablecare.plans.plan import Plan

_SCHEMA = "id string, type string, column string, how string, confidence string"


def label_evidence(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, varied, missing)``: are there labels in several spellings,
    and labels that mean "missing"?"""
    varied = label_spellings(df, columns).groupBy("column").agg(F.lit(True).alias("varied"))
    missing = (
        column_value_counts(df, columns)
        .where(label_key(F.col("value")).isin(*MISSING_LABELS))
        .groupBy("column").agg(F.lit(True).alias("missing"))
    )
    return varied.join(missing, "column", "full")


def propose(result: ProfileResult) -> DataFrame:
    """``(id, type, column, how, confidence)``: a step for every issue found.

    Columns flagged as identifiers are left as they are where values are
    missing. Steps come with a confidence: high where only one fix makes sense.
    """
    stats = result.stats
    spark = stats.sparkSession
    flags = result.flags
    flagged = flags.groupBy("column").agg(F.collect_set("flag").alias("flags"))
    labels = [r["column"] for r in stats.where("kind = 'text' AND semantic_type = 'categorical'").select("column").collect()]
    evidence = (
        label_evidence(result.source, labels) if labels
        else spark.createDataFrame([], "column string, varied boolean, missing boolean")
    )
    facts = stats.join(flagged, "column", "left").join(evidence, "column", "left")

    def has(flag: str):
        return F.coalesce(F.array_contains("flags", flag), F.lit(False))

    numeric = F.col("semantic_type").isin("numeric-continuous", "numeric-discrete")
    fill_how = (
        F.when(numeric | has("looks_numeric"), F.lit("median"))
        .when(F.col("semantic_type") == "datetime", F.lit("drop"))
        .otherwise(F.lit("mode"))
    )
    incomplete = (F.col("null_count") > 0) & (F.col("non_null") > 0) & ~has("potential_id")
    rules = [
        ("fix_whitespace", has("whitespace_issues"), F.lit("strip"), "high"),
        ("fix_dtype", has("looks_numeric"), F.lit("number"), "high"),
        ("fix_dtype", has("looks_datetime"), F.lit("timestamp"), "high"),
        ("fix_mixed_types", has("mixed_types"), F.lit("split"), "low"),
        ("fix_mixed_types", F.coalesce("missing", F.lit(False)), F.lit("missing"), "high"),
        ("fill_missing", incomplete & (fill_how != "drop"), fill_how, "medium"),
        ("drop_missing", incomplete & (fill_how == "drop"), fill_how, "medium"),
        ("standardize_categories", F.coalesce("varied", F.lit(False)), F.lit("title"), "medium"),
    ]
    steps = F.array_compact(F.array(*[
        F.when(test, F.struct(F.lit(type).alias("type"), how.alias("how"), F.lit(sure).alias("confidence")))
        for type, test, how, sure in rules
    ]))
    per_column = facts.select("column", F.inline(steps)).select(
        F.concat_ws("_", F.col("how"), F.col("column")).alias("id"), "type", "column", "how", "confidence"
    )
    whole_table = result.duplicates.where("duplicate_count > 0").select(
        F.lit("dedupe_rows").alias("id"), F.lit("drop_duplicates").alias("type"),
        F.lit(None).cast("string").alias("column"), F.lit("rows").alias("how"),
        F.lit("high").alias("confidence"),
    )
    return per_column.unionByName(whole_table)


def to_plan(proposals: Iterable[Row]) -> Plan:
    """The steps of a proposal table (a few rows per column) as a sorted plan."""
    return Plan(_op(r) for r in sorted(proposals, key=lambda r: r["id"])).sorted()


def _op(r: Row) -> Op:
    cols = [r["column"]]
    make = {
        "strip": lambda: Strip(cols, id=r["id"]),
        "number": lambda: ToNumber(cols, id=r["id"]),
        "timestamp": lambda: ToTimestamp(cols, id=r["id"]),
        "split": lambda: SplitMixed(cols, id=r["id"]),
        "missing": lambda: MissingLabels(cols, id=r["id"]),
        "median": lambda: Fill(cols, "median", id=r["id"]),
        "mode": lambda: Fill(cols, "mode", id=r["id"]),
        "drop": lambda: DropMissing(cols, id=r["id"]),
        "title": lambda: Title(cols, id=r["id"]),
        "rows": lambda: Dedupe(id=r["id"]),
    }
    return make[r["how"]]()
