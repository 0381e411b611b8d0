"""Compare a table before and after cleaning.

Each side gives one row per column (counts, means, deviations) by aggregates
with map-side combine; equal rows are counted apart. The checks are expressions
on these figures, turned into ``(name, status, message)`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecare.operators.clean import Op
from tablecare.operators.histogram import tall
from tablecare.operators.profile import duplicate_count
from tablecare.operators.schema import column, kinds, present
from tablecare.plans.plan import Plan

# Limits of the checks.
ROWS_DROPPED_FAIL = 0.50
ROWS_DROPPED_WARNING = 0.20
MEAN_SHIFT_WARNING = 2.0

SEVERITY = ("PASS", "WARNING", "FAIL")


def side_figures(df: DataFrame, side: str) -> DataFrame:
    """``(side, column, rows, values, mean, std)``: the rows of the table, where
    *column* is null, and the values of each numeric column."""
    kind = kinds(df)
    numeric = [c for c in df.columns if kind[c] in ("integer", "fraction")]
    table = df.agg(F.count(F.lit(1)).alias("rows"))
    if not numeric:
        return table.select(F.lit(side).alias("side"), F.lit(None).cast("string").alias("column"), "rows",
                            *[F.lit(None).cast(t).alias(n) for n, t in (("values", "bigint"), ("mean", "double"), ("std", "double"))])
    name = F.element_at(F.array(*[F.lit(c) for c in numeric]), F.col("pos").cast("int") + 1)
    figures = (
        tall(df, {str(i): present(df, c).cast("double") for i, c in enumerate(numeric)})
        .groupBy("pos").agg(F.count("value").alias("values"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
        .select(name.alias("column"), "values", "mean", "std")
    )
    return table.unionByName(figures, allowMissingColumns=True).withColumn("side", F.lit(side))


def _check(name, status, message) -> Column:
    return F.struct(
        name.alias("name"), status.alias("status"), message.alias("message")
    )


def row_count_status(before: Column, after: Column) -> Column:
    dropped = (before - after) / before
    return (
        F.when(before == 0, F.lit("PASS"))
        .when(dropped > ROWS_DROPPED_FAIL, F.lit("FAIL"))
        .when((dropped > ROWS_DROPPED_WARNING) | (after > before), F.lit("WARNING"))
        .otherwise(F.lit("PASS"))
    )


def _of(plan: Plan | None, *types: str) -> list[Op]:
    return [op for op in (plan.ops if plan else ()) if op.type in types]


def row_and_shift_checks(before: DataFrame, after: DataFrame) -> DataFrame:
    """The row-count check and one mean-shift check per numeric column."""
    sides = side_figures(before, "before").unionByName(side_figures(after, "after"))

    def of(side: str, figure: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(figure))).alias(f"{side}_{figure}")

    both = sides.groupBy("column").agg(
        *[of(s, f) for s in ("before", "after") for f in ("rows", "values", "mean", "std")]
    )
    rows_before, rows_after = F.col("before_rows"), F.col("after_rows")
    rows = _check(
        F.lit("row_count"), row_count_status(rows_before, rows_after),
        F.concat(F.lit("rows "), rows_before.cast("string"), F.lit(" -> "), rows_after.cast("string")),
    )
    comparable = (F.col("before_values") >= 2) & (F.col("after_values") >= 2) & (F.col("before_std") != 0)
    shift = F.try_divide(F.abs(F.col("after_mean") - F.col("before_mean")), F.col("before_std"))
    means = _check(
        F.concat(F.lit("distribution_"), F.col("column")),
        F.when(shift > MEAN_SHIFT_WARNING, F.lit("WARNING")).otherwise(F.lit("PASS")),
        F.format_string("mean moved by %.2f standard deviations", shift),
    )
    check = F.when(F.col("column").isNull(), rows).when(comparable, means)
    return both.select(check.alias("check")).where("check IS NOT NULL").select("check.*")


def null_checks(after: DataFrame, plan: Plan | None) -> DataFrame | None:
    """Columns that a fill or drop was meant to complete."""
    targets = [
        (c, op.type, op.id) for op in _of(plan, "fill_missing", "drop_missing")
        for c in op.columns() if c in after.columns
    ]
    if not targets:
        return None
    nulls = {c: F.count_if(present(after, c).isNull()) for c, _, _ in targets}
    checks = [
        _check(
            F.lit(f"nulls_{c}"),
            F.when(nulls[c] > 0, F.lit("WARNING")).otherwise(F.lit("PASS")),
            F.concat(nulls[c].cast("string"), F.lit(f" nulls left after {type} {id}".rstrip())),
        )
        for c, type, id in targets
    ]
    return after.agg(F.array(*checks).alias("checks")).select(F.inline("checks"))


def duplicate_check(after: DataFrame, plan: Plan | None) -> DataFrame:
    left = F.col("duplicate_count")
    expected_none = bool(_of(plan, "drop_duplicates"))
    status = F.when((left > 0) & F.lit(expected_none), F.lit("WARNING")).otherwise(F.lit("PASS"))
    return duplicate_count(after).select(
        _check(F.lit("duplicates"), status, F.concat(left.cast("string"), F.lit(" duplicate rows"))).alias("c")
    ).select("c.*")


def schema_checks(before: DataFrame, after: DataFrame, plan: Plan | None) -> list[tuple[str, str, str]]:
    """Missing columns, and numeric columns that became text. Schemas only."""
    allowed = {c for op in _of(plan, "drop_column", "rename_columns")
               for c in (op.columns() or list(op.mapping(before)))}
    lost = sorted(set(before.columns) - set(after.columns) - allowed)
    new = sorted(set(after.columns) - set(before.columns))
    message = f"lost columns: {', '.join(lost)}" if lost else f"{len(new)} new columns"
    checks = [("schema", "FAIL" if lost else "PASS", message)]
    retyped = {c for op in _of(plan, "fix_dtype") for c in op.columns()}
    kind_before, kind_after = kinds(before), kinds(after)
    for c in before.columns:
        if c not in kind_after or c in retyped:
            continue
        regressed = kind_before[c] in ("integer", "fraction") and kind_after[c] in ("text", "nested")
        types = f"{before.schema[c].dataType.simpleString()} -> {after.schema[c].dataType.simpleString()}"
        checks.append((f"dtype_{c}", "WARNING" if regressed else "PASS", types))
    return checks


def validate(before: DataFrame, after: DataFrame, plan: Plan | None = None) -> DataFrame:
    """All checks as ``(name, status, message)``.

    Each side is read more than once: write a cleaned table whose plan shuffles
    before it is validated.
    """
    spark = after.sparkSession
    parts = [
        row_and_shift_checks(before, after),
        spark.createDataFrame(schema_checks(before, after, plan), "name string, status string, message string"),
        null_checks(after, plan),
        duplicate_check(after, plan),
    ]
    result = parts[0]
    for part in parts[1:]:
        if part is not None:
            result = result.unionByName(part)
    return result


def roll_up(checks: DataFrame) -> DataFrame:
    """``(status, fails, warnings, passes, summary)``: the worst status wins."""
    severity = F.array(*[F.lit(s) for s in SEVERITY])
    worst = F.element_at(severity, F.coalesce(F.max(F.array_position(severity, F.col("status"))), F.lit(1)).cast("int"))
    counts = [F.count_if(F.col("status") == s).alias(n)
              for s, n in (("FAIL", "fails"), ("WARNING", "warnings"), ("PASS", "passes"))]
    return checks.agg(worst.alias("status"), *counts).withColumn(
        "summary",
        F.format_string("%s: %d failed, %d warnings, %d passed", "status", "fails", "warnings", "passes"),
    )


def compare(before: DataFrame, after: DataFrame, ops_applied: int | None = None) -> DataFrame:
    """``(measure, before, after)``: rows, columns, nulls, and steps applied."""

    def figures(df: DataFrame, side: str) -> DataFrame:
        nulls = [F.count_if(present(df, c).isNull()) for c in df.columns]
        total = sum(nulls[1:], nulls[0]) if nulls else F.lit(0)
        return df.agg(
            F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("bigint").alias("columns"),
            total.cast("bigint").alias("nulls"),
            F.lit(ops_applied if side == "after" else None).cast("bigint").alias("ops_applied"),
        ).unpivot([], ["rows", "columns", "nulls", "ops_applied"], "measure", "value").withColumn("side", F.lit(side))

    both = figures(before, "before").unionByName(figures(after, "after"))
    return both.groupBy("measure").agg(
        F.max(F.when(F.col("side") == "before", F.col("value"))).alias("before"),
        F.max(F.when(F.col("side") == "after", F.col("value"))).alias("after"),
    )
