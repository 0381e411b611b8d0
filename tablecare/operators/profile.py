"""Profile of a table: types, nulls, statistics, top values, quality flags.

Every figure of a column comes out of a handful of aggregates whose results
hold one row per column (and five top values each), whatever the table's size:

* a scan of the numeric and date columns, and one or more for exact quantiles
  (:mod:`tablecare.operators.quantiles`);
* one histogram each for whole-number, fractional and text columns;
* one count of equal rows.

They do not depend on each other and run at the same time. With ``approx=True``
each column is read twice, once for plain aggregates and once for sketches.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.functions.dates import DEFAULT_FORMATS, iso, parse_timestamp
from tablecare.functions.numbers import finite, looks_number
from tablecare.functions.text import strip
from tablecare.operators.frequency import infer_frequency
from tablecare.operators.histogram import tall, text_counts, text_key, top_values, value_counts
from tablecare.operators.jobs import together
from tablecare.operators.quantiles import exact_quantiles
from tablecare.operators.samples import sample_rows
from tablecare.operators.schema import as_text, column, kinds, present

# Thresholds, words and names that decide types and flags.
HIGH_NULL_SHARE = 0.90
IDENTIFIER_RATIO = 0.95
NAMED_IDENTIFIER_RATIO = 0.50
HIGH_CARDINALITY_RATIO = 0.50
CONSTANT_DISTINCT = 1
DISCRETE_DISTINCT = 20
DISCRETE_SHARE = 0.05
DATE_TYPE_SHARE = 0.50
DATE_FLAG_SHARE = 0.70
NUMERIC_FLAG_SHARE = 0.80
MIXED_FLAG_SHARE = 0.10
TEXT_LENGTH = 50
TOP_VALUES = 5
SKETCHED_TOGETHER = 4    # columns whose sketches share a scan
SKETCH_LG_K = 14         # sketch size: distinct counts with approx=True are off by about 1 %
BOOLEAN_WORDS = ("true", "false", "yes", "no", "y", "n", "t", "f")
ID_NAME = r"(?i)(^id$|_id$|^id_|uuid|_key$|^key$)"

_STATS = T.StructType(
    [
        T.StructField("pos", T.IntegerType()),
        T.StructField("column", T.StringType()),
        T.StructField("dtype", T.StringType()),
        T.StructField("kind", T.StringType()),
        *[T.StructField(n, T.LongType()) for n in
          ("rows", "non_null", "distinct", "finite", "distinct_finite")],
        *[T.StructField(n, T.BooleanType()) for n in ("whole", "padded", "boolean_words")],
        *[T.StructField(n, T.DoubleType()) for n in
          ("number_share", "date_share", "mean_length", "min", "max", "mean", "median", "std",
           "q1", "q3", "skewness")],
        *[T.StructField(n, T.StringType()) for n in ("min_date", "max_date", "frequency")],
    ]
)
_TOP = "pos int, rank int, value string, n bigint"


def corrected_skewness(c: Column) -> Column:
    """Sample skewness with bias correction; null for fewer than three values."""
    n = F.count(c)
    factor = F.sqrt(n * (n - 1)) / (n - 2)
    return (
        F.when(n <= 2, F.lit(None).cast("double"))
        .when(F.min(c) == F.max(c), F.lit(0.0))
        .otherwise(F.skewness(c) * factor)
    )


def number_figures(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Counts, extremes and moments, one row per ``pos`` of some double columns.

    The columns are stacked into narrow rows first: the generated code stays
    small however many columns there are, and so keeps being compiled.
    """
    d = F.col("finite_value")
    return (
        tall(df, columns)
        .select("pos", "value", finite(F.col("value")).alias("finite_value"))
        .groupBy("pos")
        .agg(
            F.count("value").alias("non_null"), F.count(d).alias("finite"), F.bool_and(d == F.floor(d)).alias("whole"),
            F.min(d).alias("min"), F.max(d).alias("max"), F.avg(d).alias("mean"),
            F.stddev_samp(d).alias("std"), corrected_skewness(d).alias("skewness"),
        )
    )


def moment_figures(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Number of values and ISO extremes, one row per ``pos`` of some date columns."""
    micros = {pos: F.unix_micros(c.cast("timestamp")) for pos, c in columns.items()}
    return tall(df, micros).groupBy("pos").agg(
        F.count("value").alias("non_null"),
        iso(F.timestamp_micros(F.min("value"))).alias("min_date"),
        iso(F.timestamp_micros(F.max("value"))).alias("max_date"),
    )


def text_figures(df: DataFrame, columns: dict[str, Column], formats) -> DataFrame:
    """Shares of numbers and dates, lengths and words, one row per ``pos``."""
    value, ts = F.col("value"), F.col("ts")
    return (
        tall(df, columns).withColumn("ts", parse_timestamp(value, formats)).groupBy("pos").agg(
            F.count("value").alias("non_null"),
            F.avg(looks_number(value).cast("int")).alias("number_share"),
            F.avg(ts.isNotNull().cast("int")).alias("date_share"),
            F.avg(F.length(value)).alias("mean_length"),
            F.bool_or(value != strip(value)).alias("padded"),
            F.coalesce(_boolean_words(F.lower(value)), F.lit(False)).alias("boolean_words"),
            iso(F.min(ts)).alias("min_date"), iso(F.max(ts)).alias("max_date"),
        )
    )


def null_report(df: DataFrame) -> DataFrame:
    """``(column, null_count, null_pct, flagged)``, one scan for all columns."""
    counts = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count(present(df, n)).alias(str(i)) for i, n in enumerate(df.columns)],
    )
    names = F.array(*[F.lit(n) for n in df.columns])
    share = F.when(F.col("__rows") > 0, F.col("null_count") / F.col("__rows")).otherwise(F.lit(0.0))
    return (
        counts.unpivot("__rows", [str(i) for i in range(len(df.columns))], "pos", "filled")
        .select(F.element_at(names, F.col("pos").cast("int") + 1).alias("column"), "__rows",
                (F.col("__rows") - F.col("filled")).alias("null_count"))
        .select("column", "null_count", share.alias("null_pct"),
                (share > HIGH_NULL_SHARE).alias("flagged"))
    )


def row_key(df: DataFrame) -> list[Column]:
    """Columns that are equal exactly for equal rows; long values as digests.

    Counting equal rows needs no more, so long texts are not shuffled.
    """
    keys = []
    for i, (name, kind) in enumerate(kinds(df).items()):
        c = text_key(as_text(df, name)) if kind in ("text", "nested") else present(df, name)
        keys.append(c.alias(f"k{i}"))
    return keys


def duplicate_count(df: DataFrame) -> DataFrame:
    """``(duplicate_count)``: rows beyond the first of each set of equal rows."""
    return (
        df.groupBy(*row_key(df)).agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_count"))
    )


def _summary_and_top(counts: DataFrame, metrics: list[Column], carried: list[str]) -> list[Row]:
    """Metrics per column and its top values out of one histogram.

    Both parts use the same columns of the histogram, so that Spark computes
    and shuffles it once.
    """
    summary = counts.groupBy("pos").agg(*metrics)
    top = top_values(counts, TOP_VALUES).select(
        "pos", "rank", F.col("value").cast("string").alias("value"), "n", *carried
    )
    return summary.unionByName(top, allowMissingColumns=True).collect()


def _boolean_words(lowered: Column) -> Column:
    """Are all values boolean words, and at most two different ones?"""
    place = F.array_position(F.array(*[F.lit(w) for w in BOOLEAN_WORDS]), lowered)
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1), place.cast("int")))
    return F.bool_and(place > 0) & (F.bit_count(bits) <= 2)


def _text_metrics() -> list[Column]:
    n = F.col("n")
    return [
        F.count("*").alias("distinct"),
        F.sum("n").alias("non_null"),
        F.sum(n * F.col("is_number")).alias("numbers"),
        F.sum(F.when(F.col("ts").isNotNull(), n).otherwise(0)).alias("dates"),
        F.sum(n * F.col("chars")).alias("total_chars"),
        F.max("padded").alias("any_padded"),
        _boolean_words(F.lower("value")).alias("words"),
        iso(F.min("ts")).alias("min_date"),
        iso(F.max("ts")).alias("max_date"),
    ]


def _exact_stats(df: DataFrame, formats) -> tuple[list[dict], list[tuple]]:
    """Statistics per column and the top values of columns, exact.

    The scans do not depend on each other and are submitted together.
    """
    kind, names = kinds(df), df.columns
    stats = _blank_stats(df)
    decimals = [i for i, n in enumerate(names) if isinstance(df.schema[n].dataType, T.DecimalType)]

    def of(*wanted: str) -> list[int]:
        return [i for i, n in enumerate(names) if kind[n] in wanted]

    counted = [F.count("*").alias("distinct"), F.sum("n").alias("non_null")]
    finite_counted = [*counted, F.count_if(finite(F.col("value")).isNotNull()).alias("distinct_finite")]
    histograms = [
        ({i: _whole_number(df, names[i]) for i in of("integer", "datetime", "boolean")}, value_counts, counted, []),
        ({i: present(df, names[i]).cast("double") for i in of("fraction") if i not in decimals},
         value_counts, finite_counted, []),
        ({i: as_text(df, names[i]) for i in sorted([*of("text", "nested"), *decimals])},
         lambda d, columns: text_counts(d, columns, formats), _text_metrics(),
         ["chars", "is_number", "ts", "padded"]),
    ]

    def histogram(columns: dict[int, Column], count, metrics: list[Column], carried: list[str]):
        def job() -> list[Row]:
            return _summary_and_top(count(df, {str(i): c for i, c in columns.items()}), metrics, carried)
        return job

    native = {names[i]: column(names[i]) for i in of("datetime")}
    fixed, frequencies, *seen = together(
        lambda: _fixed_width_stats(df), lambda: infer_frequency(df, native),
        *[histogram(*h) for h in histograms if h[0]],
    )
    for i, found in fixed.items():
        stats[i] |= found
    top: list[tuple] = []
    for r in [r for rows in seen for r in rows]:
        i = int(r["pos"])
        if r["rank"] is not None:
            top.append((i, r["rank"], r["value"], r["n"]))
            continue
        stats[i]["distinct"], stats[i]["non_null"] = r["distinct"], r["non_null"]
        if "distinct_finite" in r:
            stats[i]["distinct_finite"] = r["distinct_finite"]
        if kind[names[i]] == "text":
            stats[i] |= {
                "number_share": r["numbers"] / r["non_null"], "date_share": r["dates"] / r["non_null"],
                "mean_length": r["total_chars"] / r["non_null"], "padded": bool(r["any_padded"]),
                "boolean_words": bool(r["words"]), "min_date": r["min_date"], "max_date": r["max_date"],
            }
    for s in stats:
        if s["kind"] in ("integer", "fraction") and "distinct_finite" not in s:
            s["distinct_finite"] = s["distinct"]
    dates_in_text = {
        s["column"]: parse_timestamp(column(s["column"]), formats)
        for s in stats if s.get("date_share", 0.0) > DATE_TYPE_SHARE
    }
    for name, frequency in {**frequencies, **infer_frequency(df, dates_in_text)}.items():
        stats[names.index(name)]["frequency"] = frequency
    texts = {*of("text", "nested"), *decimals}
    return stats, [(p, r, _shown(v, kind[names[p]]), n) for p, r, v, n in _whole_texts(df, texts, top)]


def numeric_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, min, max, mean, median, std, q1, q3, skewness)`` of numeric columns."""
    kind = kinds(df)
    names = columns or [n for n in df.columns if kind[n] in ("integer", "fraction")]
    found = _fixed_width_stats(df.select(*[column(n) for n in names]))
    fields = ("min", "max", "mean", "median", "std", "q1", "q3", "skewness")
    schema = T.StructType([T.StructField("column", T.StringType()), *[T.StructField(f, T.DoubleType()) for f in fields]])
    rows = [(n, *[found[i].get(f) for f in fields]) for i, n in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, schema)


def distinct_counts(df: DataFrame) -> DataFrame:
    """``(column, distinct, cardinality_ratio)``: distinct share of the filled values."""
    kind = kinds(df)
    families: dict[str, dict[str, Column]] = {"whole": {}, "fraction": {}, "text": {}}
    for i, n in enumerate(df.columns):
        if kind[n] in ("integer", "datetime", "boolean"):
            families["whole"][str(i)] = _whole_number(df, n)
        elif kind[n] == "fraction" and not isinstance(df.schema[n].dataType, T.DecimalType):
            families["fraction"][str(i)] = present(df, n).cast("double")
        else:
            families["text"][str(i)] = text_key(as_text(df, n))
    parts = [
        value_counts(df, columns).groupBy("pos").agg(F.count("*").alias("distinct"), F.sum("n").alias("non_null"))
        for columns in families.values() if columns
    ]
    counted = reduce(DataFrame.unionByName, parts)
    name = F.element_at(F.array(*[F.lit(n) for n in df.columns]), F.col("pos").cast("int") + 1)
    every = df.sparkSession.range(len(df.columns)).select(F.col("id").cast("string").alias("pos"))
    return every.join(counted, "pos", "left").select(
        name.alias("column"), F.coalesce("distinct", F.lit(0)).alias("distinct"),
        F.coalesce(F.col("distinct") / F.col("non_null"), F.lit(0.0)).alias("cardinality_ratio"),
    )


def _whole_number(df: DataFrame, name: str) -> Column:
    """Whole numbers, moments and booleans as a bigint that is equal for equal values."""
    c, kind = column(name), kinds(df)[name]
    if kind == "datetime":
        return F.unix_micros(c.cast("timestamp"))
    return c.cast("int").cast("bigint") if kind == "boolean" else c.cast("bigint")


def _blank_stats(df: DataFrame) -> list[dict]:
    kind = kinds(df)
    return [
        {"pos": i, "column": n, "dtype": df.schema[n].dataType.simpleString(), "kind": kind[n],
         "non_null": 0, "distinct": 0}
        for i, n in enumerate(df.columns)
    ]


def _by_pos(figures: DataFrame) -> dict[int, dict]:
    """The figures of each column; one row per column comes to the driver."""
    return {int(r["pos"]): {k: v for k, v in r.asDict().items() if k != "pos"} for r in figures.collect()}


def _of_kind(df: DataFrame, *wanted: str) -> dict[str, Column]:
    kind = kinds(df)
    return {str(i): present(df, n) for i, n in enumerate(df.columns) if kind[n] in wanted}


def _fixed_width_stats(df: DataFrame) -> dict[int, dict]:
    """Counts, extremes, moments and quartiles of the columns that are no texts."""
    numbers = {pos: c.cast("double") for pos, c in _of_kind(df, "integer", "fraction").items()}
    dates = _of_kind(df, "datetime")
    rows, moments, extremes, (quartiles, _) = together(
        df.count,
        lambda: _by_pos(number_figures(df, numbers)) if numbers else {},
        lambda: _by_pos(moment_figures(df, dates)) if dates else {},
        lambda: exact_quantiles(df, {pos: finite(c) for pos, c in numbers.items()}, [0.25, 0.5, 0.75]),
    )
    found: dict[int, dict] = {i: {"rows": rows} for i in range(len(df.columns))}
    for pos in numbers:
        found[int(pos)] |= {"finite": 0, **dict(zip(("q1", "median", "q3"), quartiles[pos]))}
    for figures in (moments, extremes):
        for i, f in figures.items():
            found[i] |= f
    return found


def _shown(value: str, kind: str) -> str:
    return {"0": "false", "1": "true"}[value] if kind == "boolean" and value in "01" else value


def _whole_texts(df: DataFrame, texts: set[int], top: list[tuple]) -> list[tuple]:
    """Put the texts back where a top value is the digest of a long one."""
    digests = {(p, v) for p, _, v, _ in top if p in texts and v.startswith("#") and len(v) == 65}
    if not digests:
        return top
    found = {}
    for p in {p for p, _ in digests}:
        c = as_text(df, df.columns[p])
        key = text_key(c)
        rows = (
            df.select(key.alias("key"), c.alias("value"))
            .where(F.col("key").isin([v for q, v in digests if q == p]))
            .groupBy("key").agg(F.min("value").alias("value")).collect()
        )
        found.update({(p, r["key"]): r["value"] for r in rows})
    return [(p, r, found.get((p, v), v), n) for p, r, v, n in top]


def _sketched_distinct(key: Column, value: Column | None = None) -> Column:
    """Estimated number of distinct keys of the rows where *value* is not null."""
    value = key if value is None else value
    sketch = F.hll_sketch_agg(F.when(value.isNotNull(), key), F.lit(SKETCH_LG_K))
    return F.coalesce(F.hll_sketch_estimate(sketch), F.lit(0))


def _approximate_stats(df: DataFrame, formats) -> tuple[list[dict], list[tuple]]:
    """The same figures with sketches: each column is read twice, and nothing shuffled.

    Plain aggregates and sketches are kept apart, since one sketch would take
    the whole aggregate out of generated code.
    """
    kind, names = kinds(df), df.columns
    stats = _blank_stats(df)
    texts = {i for i, n in enumerate(names) if kind[n] in ("text", "nested")}
    data = df.select(*[
        (text_key(as_text(df, n)) if i in texts else present(df, n)).alias(f"k{i}") for i, n in enumerate(names)
    ])
    sketches: list[dict[str, Column]] = []
    for i, n in enumerate(names):
        value = F.col(f"k{i}")
        sketch = {"filled": F.count(value), "distinct": _sketched_distinct(F.xxhash64(value), value),
                  "top": F.expr(f"approx_top_k(k{i}, {TOP_VALUES}, 1000)")}
        if kind[n] in ("integer", "fraction"):
            sketch["quartiles"] = F.percentile_approx(finite(value), [0.25, 0.5, 0.75])
        if kind[n] == "fraction":
            sketch["distinct_finite"] = _sketched_distinct(F.xxhash64(value), finite(value))
        sketches.append(sketch)

    def sketched(group: list[dict[str, Column]]):
        return lambda: list(data.agg(*[F.struct(*[m.alias(k) for k, m in p.items()]) for p in group]).first())

    numbers = {pos: c.cast("double") for pos, c in _of_kind(df, "integer", "fraction").items()}
    dates, words = _of_kind(df, "datetime"), _of_kind(df, "text")
    plain = [
        (numbers, lambda: number_figures(df, numbers)), (dates, lambda: moment_figures(df, dates)),
        (words, lambda: text_figures(df, words, formats)),
    ]
    # each group of columns is read by a scan of its own, which keeps aggregates small
    groups = [sketches[i:i + SKETCHED_TOGETHER] for i in range(0, len(sketches), SKETCHED_TOGETHER)]
    rows, *seen = together(
        df.count, *[lambda f=f: _by_pos(f()) for columns, f in plain if columns], *[sketched(g) for g in groups]
    )
    exact = [f for f in seen if isinstance(f, dict)]
    rough = [r for f in seen if isinstance(f, list) for r in f]
    top = []
    for i, s in enumerate(stats):
        s |= {"rows": rows, **rough[i].asDict()}
        s["non_null"] = s.pop("filled")
        for figures in exact:
            s |= figures.get(i, {})
        for rank, (value, n) in enumerate(s.pop("top") or [], 1):
            if value is not None:
                top.append((i, rank, str(value).lower() if kind[names[i]] == "boolean" else str(value), n))
        if "quartiles" in s:
            s["q1"], s["median"], s["q3"] = s.pop("quartiles") or (None, None, None)
            s.setdefault("finite", 0)
        s["distinct"] = min(s["distinct"], s["non_null"])
        s.setdefault("distinct_finite", s["distinct"])
    return stats, _whole_texts(df, texts, top)


def semantic_type() -> Column:
    """The semantic type of a column from its statistics."""
    c = F.col
    ratio = c("cardinality_ratio")
    named = c("column").rlike(ID_NAME)
    discrete_cap = F.greatest(F.lit(DISCRETE_DISTINCT), F.floor(c("rows") * DISCRETE_SHARE))
    numeric = (
        F.when(c("finite") == 0, F.lit("numeric-continuous"))
        .when((c("kind") == "integer") & (c("distinct_finite") / c("rows") > IDENTIFIER_RATIO), F.lit("identifier"))
        .when(c("whole") & (c("distinct_finite") <= discrete_cap), F.lit("numeric-discrete"))
        .otherwise(F.lit("numeric-continuous"))
    )
    text = (
        F.when(c("non_null") == 0, F.lit("unknown"))
        .when(c("boolean_words"), F.lit("boolean"))
        .when(c("date_share") > DATE_TYPE_SHARE, F.lit("datetime"))
        .when(named & (ratio > NAMED_IDENTIFIER_RATIO), F.lit("identifier"))
        .when(ratio > IDENTIFIER_RATIO, F.lit("identifier"))
        .when(c("mean_length") > TEXT_LENGTH, F.lit("text"))
        .otherwise(F.lit("categorical"))
    )
    return (
        F.when(c("kind").isin("boolean", "datetime"), c("kind"))
        .when(c("kind").isin("integer", "fraction"), numeric)
        .when(c("kind") == "text", text)
        .otherwise(F.lit("unknown"))
    )


def quality_flags(stats: DataFrame) -> DataFrame:
    """``(pos, column, flag, measure)`` from the statistics per column."""
    c = F.col
    ratio, number_share = c("cardinality_ratio"), c("number_share")
    varied = (c("non_null") > 0) & (c("distinct") > CONSTANT_DISTINCT)
    identifier = (c("column").rlike(ID_NAME) & (ratio > NAMED_IDENTIFIER_RATIO)) | (ratio > IDENTIFIER_RATIO)
    is_text = varied & (c("kind") == "text")
    flags = [
        ("high_nulls", c("null_pct") > HIGH_NULL_SHARE, c("null_pct")),
        ("constant_column", (c("non_null") > 0) & ~varied, c("distinct").cast("double")),
        ("potential_id", varied & identifier, ratio),
        ("high_cardinality", varied & ~identifier & (ratio > HIGH_CARDINALITY_RATIO), ratio),
        ("whitespace_issues", is_text & c("padded"), F.lit(None).cast("double")),
        ("looks_numeric", is_text & (number_share >= NUMERIC_FLAG_SHARE), number_share),
        ("mixed_types", is_text & (number_share >= MIXED_FLAG_SHARE) & (number_share < NUMERIC_FLAG_SHARE), number_share),
        ("looks_datetime", is_text & (number_share < MIXED_FLAG_SHARE) & (c("date_share") >= DATE_FLAG_SHARE), c("date_share")),
    ]
    raised = F.array_compact(
        F.array(*[F.when(test, F.struct(F.lit(name).alias("flag"), m.alias("measure"))) for name, test, m in flags])
    )
    return stats.select("pos", "column", F.inline(raised))


@dataclass
class ProfileResult:
    """A profile as DataFrames with one row per column, flag or top value."""

    source: DataFrame
    stats: DataFrame
    top: DataFrame
    duplicates: DataFrame
    order_by: list[str] | None = None
    seed: int = 0
    _numeric: tuple = field(default=("numeric-continuous", "numeric-discrete"), repr=False)

    @property
    def columns(self) -> DataFrame:
        """Breakdown: column, dtype, semantic type, null share, high-null mark."""
        return self.stats.select(
            "pos", "column", "dtype", "semantic_type", "null_pct",
            (F.col("null_pct") > HIGH_NULL_SHARE).alias("flagged"),
        )

    @property
    def nulls(self) -> DataFrame:
        return self.stats.select(
            "column", "null_count", "null_pct", (F.col("null_pct") > HIGH_NULL_SHARE).alias("flagged")
        )

    @property
    def numeric(self) -> DataFrame:
        return self.stats.where(F.col("semantic_type").isin(*self._numeric)).select(
            "column", "min", "max", "mean", "median", "std", "q1", "q3", "skewness"
        )

    def _is_categorical(self) -> Column:
        return ~F.col("semantic_type").isin(*self._numeric, "datetime")

    @property
    def categorical(self) -> DataFrame:
        return self.stats.where(self._is_categorical()).select(
            "column", F.col("distinct").alias("unique_count"), "cardinality_ratio"
        )

    @property
    def top_values(self) -> DataFrame:
        """``(column, rank, value, n)`` of the columns with category statistics."""
        names = self.stats.where(self._is_categorical()).select("pos", "column")
        return self.top.join(names, "pos").select("column", "rank", "value", "n")

    @property
    def datetime(self) -> DataFrame:
        return self.stats.where(F.col("semantic_type") == "datetime").select(
            "column", "min_date", "max_date", F.col("frequency").alias("inferred_frequency")
        )

    @property
    def flags(self) -> DataFrame:
        return quality_flags(self.stats)

    @property
    def samples(self) -> DataFrame:
        return sample_rows(self.source, order_by=self.order_by, seed=self.seed)

    @property
    def summary(self) -> DataFrame:
        """One row: rows, columns, duplicates, completeness in %, flags."""
        flags = quality_flags(self.stats).groupBy("pos").agg(F.count("*").alias("flags"))
        return (
            self.stats.join(flags, "pos", "left")
            .agg(
                F.max("rows").alias("row_count"),
                F.count("*").alias("column_count"),
                ((1 - F.sum("null_count") / F.greatest(F.sum("rows"), F.lit(1))) * 100).alias("completeness"),
                F.coalesce(F.sum("flags"), F.lit(0)).alias("flag_count"),
            )
            .withColumn("duplicate_count", self.duplicates.scalar())
        )


def profile(
    df: DataFrame,
    *,
    order_by: list[str] | None = None,
    date_formats=DEFAULT_FORMATS,
    approx: bool = False,
    seed: int = 0,
) -> ProfileResult:
    """Profile *df*. The aggregates run here; the result is small DataFrames.

    *order_by* names the columns that order the rows, for the first and last
    sample rows. *approx* trades exact distinct counts, quantiles and top values
    for two readings without a shuffle; duplicates and date frequencies are then left out (null).
    """
    spark: SparkSession = df.sparkSession
    if approx:
        stats, top = _approximate_stats(df, date_formats)
        duplicate_rows = spark.createDataFrame([(None,)], "duplicate_count bigint")
    else:
        stats, top = _exact_stats(df, date_formats)
        duplicate_rows = duplicate_count(df)
    rows = [tuple(s.get(f.name) for f in _STATS.fields) for s in stats]
    frame = (
        spark.createDataFrame(rows, _STATS)
        .withColumn("null_count", F.col("rows") - F.col("non_null"))
        .withColumn("null_pct", F.when(F.col("rows") > 0, F.col("null_count") / F.col("rows")).otherwise(0.0))
        .withColumn("cardinality_ratio",
                    F.when(F.col("non_null") > 0, F.col("distinct") / F.col("non_null")).otherwise(0.0))
    )
    frame = frame.withColumn("semantic_type", semantic_type())
    return ProfileResult(df, frame, spark.createDataFrame(top, _TOP), duplicate_rows, order_by, seed)
