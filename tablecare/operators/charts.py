"""Datasets behind charts: series, bars, shares, bins, and the choice of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecare.functions.dates import period_label, whole_days
from tablecare.functions.numbers import finite
from tablecare.operators.profile import ProfileResult
from tablecare.operators.schema import column, present

# What makes a column fit for a chart, and how much is shown.
MONEY_WORDS = ("amount", "revenue", "sales", "spend", "cost", "price", "total", "salary", "profit", "fee")
INDEX_NAMES = ("index", "id", "row", "unnamed")
MIN_NUMERIC_DISTINCT = 5
MIN_LABELS, MAX_LABELS, MAX_SLICES = 2, 25, 8
MAX_LABEL_SHARE = 0.8
MONTHLY_ABOVE_DAYS, WEEKLY_ABOVE_DAYS = 180, 30
TOP_BARS, TOP_SLICES, BINS, MAX_CHARTS = 12, 8, 30, 6
BAR_CHARTS, PIE_CHARTS, HISTOGRAMS = 2, 1, 2


def period_for(days: Column) -> Column:
    """month, week or day for a span in whole days; month when unknown."""
    return (
        F.when(days.isNull() | (days > MONTHLY_ABOVE_DAYS), F.lit("month"))
        .when(days > WEEKLY_ABOVE_DAYS, F.lit("week"))
        .otherwise(F.lit("day"))
    )


def span(df: DataFrame, ts: str) -> DataFrame:
    """``(first, last, days, period)`` of a date column."""
    c = column(ts)
    return df.agg(F.min(c).alias("first"), F.max(c).alias("last")).withColumn(
        "days", whole_days(F.col("first"), F.col("last"))
    ).withColumn("period", period_for(F.col("days")))


def _aggregate(agg: str, value: Column) -> Column:
    if agg not in ("sum", "mean"):
        raise ValueError(f"unknown aggregate {agg!r}")
    return F.coalesce(F.sum(value), F.lit(0)) if agg == "sum" else F.avg(value)


def series(df: DataFrame, ts: str, num: str, agg: str = "sum") -> DataFrame:
    """``(bucket, value)``: sum or mean per month, week or day.

    The period follows from the span of the dates. Buckets without rows are 0
    for sums and left out for means. The full list of buckets is as long as the
    span in periods, whatever the number of rows.
    """
    found = span(df, ts).select(
        "period",
        *[period_label(F.col(e), p).alias(f"{e}_{p}") for e in ("first", "last") for p in ("month", "week", "day")],
    ).first()
    period = found["period"]
    first, last = found[f"first_{period}"], found[f"last_{period}"]
    value = present(df, num)
    data = (
        df.where(column(ts).isNotNull())
        .groupBy(period_label(column(ts), period).alias("bucket"))
        .agg(_aggregate(agg, value).cast("double").alias("value"))
    )
    if agg == "mean":
        return data.where(F.col("value").isNotNull())
    if first is None:
        return data
    step = {"month": "INTERVAL 1 MONTH", "week": "INTERVAL 7 DAYS", "day": "INTERVAL 1 DAY"}[period]
    days = F.expr(f"sequence(DATE'{first}', DATE'{last}', {step})")
    if period == "month":  # step from the first of a month, then go to its end
        days = F.transform(F.expr(f"sequence(trunc(DATE'{first}', 'MM'), DATE'{last}', {step})"), F.last_day)
    spine = df.sparkSession.range(1).select(F.explode(days).alias("bucket"))
    return spine.join(data, "bucket", "left").select("bucket", F.coalesce("value", F.lit(0.0)).alias("value"))


def by_category(df: DataFrame, cat: str, num: str, agg: str = "mean", n: int = TOP_BARS) -> DataFrame:
    """``(label, value)``: the *n* labels with the highest mean or sum, ties by label."""
    value = present(df, num)
    return (
        df.where(column(cat).isNotNull())
        .groupBy(column(cat).alias("label"))
        .agg(_aggregate(agg, value).cast("double").alias("value"))
        .orderBy(F.desc_nulls_last("value"), F.asc("label"))
        .limit(n)
    )


def shares(df: DataFrame, cat: str, n: int = TOP_SLICES) -> DataFrame:
    """``(label, n)``: the *n* most frequent labels, ties by label."""
    return (
        df.where(column(cat).isNotNull())
        .groupBy(column(cat).alias("label")).agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), F.asc("label")).limit(n)
    )


def bins(df: DataFrame, num: str, n: int = BINS) -> DataFrame:
    """``(bin, low, high, n)``: *n* bins of equal width, one bin for equal values.

    The extremes come from a first aggregate and enter the plan as literals. A value's bin is found by the width that the
    bounds are made of: ``width_bucket`` divides by the whole range, and so rounds values at a bound to the other side.
    """
    v = finite(column(num))
    low, high = df.agg(F.min(v), F.max(v)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin bigint, low double, high double, n bigint")
    step = (high - low) / n
    width = F.lit(step)
    if step == 0:
        number = F.lit(1).cast("bigint")
    else:
        number = F.least(F.floor((v - F.lit(low)) / width) + 1, F.lit(n).cast("bigint"))
    counted = df.where(v.isNotNull()).groupBy(number.alias("bin")).agg(F.count("*").alias("n"))
    return counted.select(
        "bin", (F.lit(low) + (F.col("bin") - 1) * width).alias("low"), (F.lit(low) + F.col("bin") * width).alias("high"), "n"
    )


def money_like(name: Column) -> Column:
    lowered = F.lower(name)
    return F.greatest(*[lowered.contains(w) for w in MONEY_WORDS])


def candidates(result: ProfileResult) -> DataFrame:
    """``(pos, column, role, distinct, std, money)`` of the columns fit for charts.

    A column can be both a category for bars and one for a pie.
    """
    c = F.col
    labels = (c("kind") == "text") & c("distinct").between(MIN_LABELS, MAX_LABELS)
    roles = [
        ("date", c("kind") == "datetime"),
        ("numeric", c("kind").isin("integer", "fraction") & (c("distinct") > MIN_NUMERIC_DISTINCT)
         & ~F.lower("column").isin(*INDEX_NAMES)),
        ("category", labels & (c("distinct") / c("rows") < MAX_LABEL_SHARE)),
        ("pie", labels & (c("distinct") <= MAX_SLICES)),
    ]
    fit = F.array_compact(F.array(*[F.when(test, F.lit(role)) for role, test in roles]))
    return result.stats.select(
        "pos", "column", F.explode(fit).alias("role"), "distinct", "std", money_like(c("column")).alias("money")
    )


def pick(result: ProfileResult, max_charts: int = MAX_CHARTS) -> DataFrame:
    """``(slot, chart, x, y, agg)``: which charts to draw of a table.

    One series, up to two bar charts (most labels first), one pie (most
    labels) and two histograms (widest spread first). Series and bars show the
    first money-like number as a sum, or else the first number as a mean.
    """
    found = candidates(result)
    number = F.col("role") == "numeric"
    # money-like numbers first, then by position
    best = F.min(F.when(number, F.struct((~F.col("money")).alias("other"), "pos", "column")))
    date = F.min(F.when(F.col("role") == "date", F.struct("pos", "column")))
    chosen = found.agg(best.alias("y"), date.alias("x"))
    agg = F.when(F.col("y.other"), F.lit("mean")).otherwise(F.lit("sum"))
    line = chosen.where("x IS NOT NULL AND y IS NOT NULL").select(
        F.lit(1).alias("kind"), F.lit(1).alias("nth"), F.lit("series").alias("chart"),
        F.col("x.column").alias("x"), F.col("y.column").alias("y"), agg.alias("agg"),
    )
    orders = {
        "category": (2, "bars", F.desc("distinct"), BAR_CHARTS),
        "pie": (3, "pie", F.desc("distinct"), PIE_CHARTS),
        "numeric": (4, "histogram", F.desc_nulls_last("std"), HISTOGRAMS),
    }
    slots = line
    measure = chosen.select("y.column").scalar()
    measure_agg = chosen.select(agg).scalar()
    none = F.lit(None).cast("string")
    for role, (kind, chart, order, limit) in orders.items():
        w = Window.orderBy(order, "pos")
        part = found.where(F.col("role") == role).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= limit)
        y, how = (measure, measure_agg) if chart == "bars" else (none, none)
        part = part.select(F.lit(kind).alias("kind"), "nth", F.lit(chart).alias("chart"),
                           F.col("column").alias("x"), y.alias("y"), how.alias("agg"))
        slots = slots.unionByName(part.where("y IS NOT NULL") if chart == "bars" else part)
    w = Window.orderBy("kind", "nth")
    return (
        slots.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= max_charts)
        .select("slot", "chart", "x", "y", "agg")
    )
