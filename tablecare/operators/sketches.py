"""A profile that is kept as a table and merged: new data is read once, old data never again.

Each column of each part (a day, a load, a file) is one row of bounded size: counts, extremes, central moments, and sketches of
distinct values (HyperLogLog), of ranks (KLL) and of frequent values. Rows of one column merge into one row of the same
form, so parts can be merged in any grouping and the result merged again. Counts and extremes of a merged profile are those of the
whole table, moments too but for rounding; the sketches keep their error bounds:

* distinct: relative standard error 1.04 / sqrt(2 ** LOG_K), 1.6 %
* ranks: a quantile's true rank is within RANK_ERROR of the wanted one (99 % of the time)
* frequent values: a count is off by at most 3.5 / TOP_ITEMS of the column's values, and no value above that is missing

Numbers, moments and booleans are profiled as doubles (moments as microseconds), other columns as texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecare.functions.dates import DEFAULT_FORMATS, parse_timestamp
from tablecare.functions.numbers import finite, looks_number
from tablecare.functions.text import strip
from tablecare.operators.joins import small_side
from tablecare.operators.schema import as_text, column, kinds, present

LOG_K = 12
RANK_K = 200
RANK_ERROR = 0.0165
TOP_ITEMS = 1024

_KEYS = ["part", "pos", "column", "kind"]
_COUNTS = ["rows", "non_null", "finite", "numbers", "dates", "chars"]


def _as_number(df: DataFrame, name: str, kind: str) -> Column:
    if kind == "datetime":
        return F.unix_micros(column(name).cast("timestamp")).cast("double")
    # adding nothing makes one zero of the two
    return present(df, name).cast("double") + F.lit(0.0)


def _stacked(df: DataFrame, part: Column, columns: dict[str, Column]) -> DataFrame:
    wide = df.select(part.alias("part"), *[c.alias(pos) for pos, c in columns.items()])
    return wide.unpivot(["part"], list(columns), "pos", "value").where(F.col("value").isNotNull())


def _sketches(text: Column) -> list[Column]:
    return [F.hll_sketch_agg(text, F.lit(LOG_K)).alias("distinct"),
            F.call_function("approx_top_k_accumulate", text, F.lit(TOP_ITEMS)).alias("top")]


def _number_rows(df: DataFrame, part: Column, columns: dict[str, Column]) -> DataFrame:
    d, n = F.col("d"), F.count("d")
    m2 = F.coalesce(F.var_pop(d) * n, F.lit(0.0))
    none = F.lit(None)
    return _stacked(df, part, columns).select("part", "pos", "value", finite(F.col("value")).alias("d")).groupBy("part", "pos").agg(
        F.count("*").alias("non_null"), n.alias("finite"), F.avg(d).alias("mean"), m2.alias("m2"),
        F.coalesce(F.skewness(d) * F.pow(m2, F.lit(1.5)) / F.sqrt(n), F.lit(0.0)).alias("m3"), F.min(d).alias("low"), F.max(d).alias("high"),
        F.kll_sketch_agg_double(d, RANK_K).alias("ranks"), *_sketches(F.col("value").cast("string")),
    ).withColumns({c: none.cast("bigint") for c in ("numbers", "dates", "chars")} | {"padded": none.cast("boolean")})


def _text_rows(df: DataFrame, part: Column, columns: dict[str, Column], formats) -> DataFrame:
    value = F.col("value")
    none = F.lit(None).cast("double")
    return _stacked(df, part, columns).groupBy("part", "pos").agg(
        F.count("*").alias("non_null"), F.count_if(looks_number(value)).alias("numbers"), F.count(parse_timestamp(value, formats)).alias("dates"),
        F.sum(F.length(value)).alias("chars"), F.bool_or(value != strip(value)).alias("padded"), *_sketches(value),
    ).withColumns({c: none for c in ("mean", "m2", "m3", "low", "high")} | {"finite": F.lit(None).cast("bigint"), "ranks": F.lit(None).cast("binary")})


def sketch_profile(df: DataFrame, part: Column | None = None, formats=DEFAULT_FORMATS) -> DataFrame:
    """A row per part and column, to be written to a table and merged: see :func:`merge_profiles` and :func:`profile_figures`.

    *part* is any text column of *df*; without one the table is one part. Each column is read once, and each task hands on one row
    a column and part.
    """
    kind = kinds(df)
    part = F.lit("all") if part is None else part.cast("string")
    numeric = ("integer", "fraction", "datetime", "boolean")
    numbers = {str(i): _as_number(df, n, kind[n]) for i, n in enumerate(df.columns) if kind[n] in numeric}
    texts = {str(i): as_text(df, n) for i, n in enumerate(df.columns) if kind[n] not in numeric}
    found = [_number_rows(df, part, numbers)] if numbers else []
    found += [_text_rows(df, part, texts, formats)] if texts else []
    seen = found[0].unionByName(found[1]) if len(found) > 1 else found[0]
    names = F.array(*[F.struct(F.lit(str(i)).alias("pos"), F.lit(n).alias("column"), F.lit(kind[n]).alias("kind")) for i, n in enumerate(df.columns)])
    # a column without values has a row too
    every = df.groupBy(part.alias("part")).agg(F.count("*").alias("rows")).select("part", "rows", F.explode(names).alias("c")).select("part", "rows", "c.*")
    same = F.col("e.part").eqNullSafe(F.col("s.part")) & (F.col("e.pos") == F.col("s.pos"))
    rows = every.alias("e").join(seen.alias("s"), same, "left")
    counts = [F.coalesce(f"s.{c}", F.lit(0).cast("bigint")).alias(c) for c in _COUNTS[1:]]
    return rows.select("e.part", F.col("e.pos").cast("int").alias("pos"), "e.column", "e.kind", "e.rows", *counts,
                       *[f"s.{c}" for c in ("mean", "m2", "m3", "low", "high", "padded", "ranks", "distinct", "top")])


def merge_profiles(profiles: DataFrame, into: str = "all") -> DataFrame:
    """One row per column out of the rows of all parts, in the same form, as part *into*.

    Columns are matched by name and kind; ``pos`` is the least place that a column had.
    """
    key = ["column", "kind"]
    means = profiles.groupBy(*key).agg((F.sum(F.col("finite") * F.col("mean")) / F.sum("finite")).alias("whole_mean"))
    off = F.col("mean") - F.col("whole_mean")
    n = F.col("finite")
    # moments about the mean of the whole
    moved = profiles.join(small_side(means), key).withColumns({
        "m2": F.col("m2") + n * off * off, "m3": F.col("m3") + 3 * off * F.col("m2") + n * off * off * off})
    # states of columns without values are null, which the function does not take
    top = profiles.where(F.col("top").isNotNull()).groupBy(*key).agg(F.call_function("approx_top_k_combine", "top", F.lit(TOP_ITEMS)).alias("top"))
    merged = moved.groupBy(*key).agg(
        F.min("pos").alias("pos"), *[F.sum(c).alias(c) for c in _COUNTS], F.first("whole_mean").alias("mean"), F.sum("m2").alias("m2"), F.sum("m3").alias("m3"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.bool_or("padded").alias("padded"), F.kll_merge_agg_double("ranks").alias("ranks"),
        F.hll_union_agg("distinct", F.lit(True)).alias("distinct"))
    return merged.join(top, key, "left").select(F.lit(into).alias("part"), *profiles.columns[1:])


def profile_figures(profiles: DataFrame, top: int = 5) -> DataFrame:
    """What the rows of a profile say: one row of figures per part and column.

    Columns: part, pos, column, kind, rows, non_null, null_share, distinct (estimate), min, max, mean, std, skewness, q1, median, q3 (estimates),
    number_share, date_share, mean_length, padded, top (values with estimated counts, the most frequent first).
    """
    n, m2 = F.col("finite"), F.col("m2")
    skewness = F.when(n <= 2, None).when(F.col("low") == F.col("high"), 0.0).otherwise(
        F.sqrt(n) * F.col("m3") / F.pow(m2, F.lit(1.5)) * F.sqrt(n * (n - 1)) / (n - 2))
    ranks = F.when(n > 0, F.col("ranks"))
    filled = F.when(F.col("non_null") > 0, F.col("non_null"))
    share = [(F.col(c) / filled).alias(name) for c, name in (("numbers", "number_share"), ("dates", "date_share"), ("chars", "mean_length"))]
    texts = ~F.col("kind").isin("integer", "fraction", "datetime", "boolean")
    quantiles = [F.kll_sketch_get_quantile_double(ranks, F.lit(q)).alias(name) for q, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    estimated = F.when(F.col("top").isNotNull(), F.call_function("approx_top_k_estimate", F.col("top"), F.lit(top)))
    return profiles.select(
        *_KEYS, "rows", "non_null", ((F.col("rows") - F.col("non_null")) / F.when(F.col("rows") > 0, F.col("rows"))).alias("null_share"),
        F.coalesce(F.hll_sketch_estimate("distinct"), F.lit(0).cast("bigint")).alias("distinct"), F.col("low").alias("min"), F.col("high").alias("max"), "mean",
        F.when(n > 1, F.sqrt(m2 / (n - 1))).alias("std"), skewness.alias("skewness"), *quantiles,
        *[F.when(texts, c).alias(name) for c, name in zip(share, ("number_share", "date_share", "mean_length"))], "padded",
        F.transform(estimated, lambda x: F.struct(x["item"].alias("value"), x["count"].alias("n"))).alias("top"))


def store_profile(df: DataFrame, path: str, part: str) -> None:
    """Add the rows of *df*, as part *part*, to the profile kept at *path*; a part that is there already is replaced."""
    rows = sketch_profile(df).withColumn("part", F.lit(part))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def stored_profile(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all parts kept at *path*."""
    rows = spark.read.option("basePath", path).parquet(path)
    return rows.select(F.col("part").cast("string").alias("part"), *[c for c in rows.columns if c != "part"])
