"""Sets of scalar KPIs, all computed by one aggregate over the table."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecare.functions.numbers import finite
from tablecare.operators.clean import expression, lenient
from tablecare.operators.quantiles import exact_quantiles

PRIORITIES = ("high", "medium", "low")
SCORECARDS = 6
_SCHEMA = "position int, kpi string, value double, unit string, priority string"


# Aggregates that keep all values of a column in one task.
_HELD = re.compile(r"\b(median|percentile|percentile_cont|percentile_disc|mode|collect_list|collect_set|array_agg|listagg|string_agg|histogram_numeric)\s*\(", re.IGNORECASE)


@dataclass(frozen=True)
class Kpi:
    """A named figure. *sql* is an aggregate, such as ``sum(price * quantity)``.

    With *quantile* (0.5 for the median) *sql* is an expression per row
    instead, and its exact quantile is the figure.
    """

    name: str
    sql: str
    unit: str = ""
    priority: str = "medium"
    quantile: float | None = None
    category: str = ""


def share_of_rows(predicate: str) -> str:
    """SQL of the rows, in %, for which a predicate holds."""
    return f"try_divide(count_if({predicate}), count(*)) * 100"


def null_share(column: str) -> str:
    return share_of_rows(f"`{column}` IS NULL")


def mean_days(start: str, end: str) -> str:
    """SQL of the mean of whole days from start to end."""
    seconds = f"(unix_micros(CAST({end} AS TIMESTAMP)) - unix_micros(CAST({start} AS TIMESTAMP))) / 1000000"
    return f"avg(floor({seconds} / 86400))"


def mean_age_days(column: str, as_of: str = "current_timestamp()") -> str:
    """SQL of the mean age in whole days at *as_of*."""
    return mean_days(column, as_of)


def _works(df: DataFrame, kpi: Kpi) -> bool:
    """Does the expression fit the table and give one number?"""
    try:
        held = _HELD.search(kpi.sql)
        if held:
            raise ValueError(f"{held.group(1)} holds all values in one task: use quantile=")
        if kpi.quantile is None:
            field = df.agg(expression(kpi.sql).cast("double").alias("v")).schema["v"]
        else:
            field = df.select(expression(kpi.sql).cast("double").alias("v")).schema["v"]
        return field is not None
    except (PySparkException, ValueError):
        return False


def screen_kpis(df: DataFrame, kpis: Sequence[Kpi]) -> list[Kpi]:
    """The KPIs whose expressions name only what the table has."""
    with lenient(df.sparkSession):
        return [k for k in kpis if _works(df, _ranked(k))]


def kpis(df: DataFrame, wanted: Sequence[Kpi]) -> DataFrame:
    """``(position, kpi, value, unit, priority)``; null where an expression fails.

    Aggregates share one scan. Quantiles are exact at any size and need a
    second one (:func:`exact_quantiles`).
    """
    wanted = [_ranked(k) for k in wanted]
    with lenient(df.sparkSession):
        return _kpis(df, wanted)


def _ranked(kpi: Kpi) -> Kpi:
    """A plain median as a quantile, which no task has to hold."""
    found = re.fullmatch(r"\s*median\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*", kpi.sql, re.IGNORECASE)
    return replace(kpi, sql=found.group(1), quantile=0.5) if found and kpi.quantile is None else kpi


def _kpis(df: DataFrame, wanted: Sequence[Kpi]) -> DataFrame:
    good = set(screen_kpis(df, wanted))
    plain = [k for k in wanted if k in good and k.quantile is None]
    ranked = [k for k in wanted if k in good and k.quantile is not None]

    def row(position: int, kpi: Kpi, value: Column) -> Column:
        return F.struct(
            F.lit(position).alias("position"), F.lit(kpi.name).alias("kpi"),
            value.cast("double").alias("value"),
            F.lit(kpi.unit).alias("unit"), F.lit(kpi.priority).alias("priority"),
        )

    if ranked:
        probs = sorted({k.quantile for k in ranked})
        found, extra = exact_quantiles(
            df, {str(i): finite(expression(k.sql)) for i, k in enumerate(ranked)},
            probs, [expression(k.sql).cast("double") for k in plain],
        )
        values = dict(zip(plain, extra)) | {
            k: found[str(i)][probs.index(k.quantile)] for i, k in enumerate(ranked)
        }
        rows = [(i, k.name, values.get(k), k.unit, k.priority) for i, k in enumerate(wanted)]
        return df.sparkSession.createDataFrame(rows, _SCHEMA)
    rows = [row(i, k, expression(k.sql) if k in good else F.lit(None)) for i, k in enumerate(wanted)]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def scorecard(values: DataFrame, limit: int = SCORECARDS) -> DataFrame:
    """The figures to show first: those with a value, high priority before others."""
    return (
        values.where(F.col("value").isNotNull() & ~F.isnan("value"))
        .orderBy((F.col("priority") != "high").cast("int"), "position")
        .limit(limit)
    )
