from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablecare.operators.clean import Dedupe
from tablecare import profile
from tablecare.operators.frequency import infer_frequency
from tablecare.operators.histogram import column_value_counts
from tablecare.operators.profile import distinct_counts, duplicate_count, null_report
from tablecare.operators.quantiles import exact_quantiles
from tablecare.operators.samples import sample_rows


def column_of(spark, values, dtype="string", name="c"):
    return spark.createDataFrame([(v,) for v in values], f"`{name}` {dtype}")


def semantic(df, **kw):
    return {r["column"]: r["semantic_type"] for r in profile(df, **kw).columns.collect()}


def flags(df, **kw):
    return {(r["column"], r["flag"]) for r in profile(df, **kw).flags.collect()}


def messy(spark):
    """A small table with one feature per column."""
    rows = []
    for i in range(40):
        rows.append((
            f"T{i % 38:03d}", f" {i}.5 " if i % 10 else "abc", f"2022-01-{i % 28 + 1:02d}" if i % 2 else f"{i % 28 + 1:02d}/01/2022",
            " Shop" if i == 3 else f"Shop{i % 4}", "only" if i == 5 else None, "same", ["Yes", "no"][i % 2],
            None if i % 4 == 0 else float(1000 + i), "word " * 12 + str(i % 6),
        ))
    return spark.createDataFrame(
        rows, "ticket_id string, amount string, day string, shop string, note string, fixed string, answer string, "
              "credit double, remark string"
    )


def test_types_and_flags_of_a_messy_table(spark):
    types = semantic(messy(spark))
    assert types == {"ticket_id": "identifier", "amount": "categorical", "day": "datetime", "shop": "categorical",
                     "note": "identifier", "fixed": "categorical", "answer": "boolean", "credit": "numeric-continuous",
                     "remark": "text"}
    assert flags(messy(spark)) == {
        ("ticket_id", "potential_id"), ("amount", "whitespace_issues"), ("amount", "looks_numeric"), ("amount", "high_cardinality"),
        ("day", "looks_datetime"), ("day", "high_cardinality"), ("shop", "whitespace_issues"), ("note", "high_nulls"),
        ("note", "constant_column"), ("fixed", "constant_column"), ("credit", "potential_id"),
    }


def test_approximate_profile_agrees_on_a_small_table(spark):
    assert semantic(messy(spark), approx=True) == semantic(messy(spark))
    assert flags(messy(spark), approx=True) == flags(messy(spark))
    top = {(r["column"], r["value"], r["n"]) for r in profile(messy(spark), approx=True).top_values.collect()}
    assert ("answer", "Yes", 20) in top and ("fixed", "same", 40) in top


@pytest.mark.parametrize("nulls, flagged", [(90, False), (91, True)])
def test_null_share_must_be_above_ninety_percent(spark, nulls, flagged):
    df = column_of(spark, [None] * nulls + ["v"] * (100 - nulls))
    assert null_report(df).first()["flagged"] is flagged
    assert (("c", "high_nulls") in flags(df)) is flagged


def test_nan_counts_as_missing_and_infinity_does_not(spark):
    df = column_of(spark, [1.0, float("nan"), None, float("inf"), 3.0], "double")
    assert null_report(df).first()["null_count"] == 2
    stats = profile(df).stats.first()
    assert (stats["non_null"], stats["finite"], stats["distinct"], stats["max"]) == (3, 2, 3, 3.0)


@pytest.mark.parametrize("distinct, expected", [(20, "numeric-discrete"), (21, "numeric-continuous")])
def test_discrete_cap_of_small_tables(spark, distinct, expected):
    df = column_of(spark, [float(i % distinct) for i in range(200)], "double")
    assert semantic(df) == {"c": expected}


@pytest.mark.parametrize("distinct, expected", [(50, "numeric-discrete"), (51, "numeric-continuous")])
def test_discrete_cap_is_a_share_of_the_rows(spark, distinct, expected):
    assert semantic(column_of(spark, [i % distinct for i in range(1000)], "int")) == {"c": expected}


@pytest.mark.parametrize("distinct, expected", [(95, "numeric-continuous"), (96, "identifier")])
def test_whole_numbers_above_the_ratio_are_identifiers(spark, distinct, expected):
    assert semantic(column_of(spark, [i % distinct for i in range(100)], "bigint")) == {"c": expected}


def test_fractions_are_never_identifiers_but_may_be_flagged(spark):
    df = column_of(spark, [float(i) for i in range(100)], "double")
    assert semantic(df) == {"c": "numeric-continuous"} and flags(df) == {("c", "potential_id")}


@pytest.mark.parametrize("distinct, name, flag", [
    (50, "c", None), (51, "c", "high_cardinality"), (95, "c", "high_cardinality"), (96, "c", "potential_id"),
    (51, "ORDER_ID", "potential_id"), (50, "order_id", None), (51, "uuid4", "potential_id"), (51, "idle", "high_cardinality"),
])
def test_cardinality_flags(spark, distinct, name, flag):
    df = column_of(spark, [f"v{i % distinct}" for i in range(100)], name=name)
    assert flags(df) == ({(name, flag)} if flag else set())


@pytest.mark.parametrize("numbers, flag", [(9, None), (10, "mixed_types"), (79, "mixed_types"), (80, "looks_numeric")])
def test_numeric_share(spark, numbers, flag):
    df = column_of(spark, [str(i % 7) for i in range(numbers)] + [f"w{i % 7}" for i in range(100 - numbers)])
    assert flags(df) == ({("c", flag)} if flag else set())


@pytest.mark.parametrize("dates, type, flagged", [(50, "categorical", False), (51, "datetime", False), (69, "datetime", False), (70, "datetime", True)])
def test_date_share(spark, dates, type, flagged):
    df = column_of(spark, [f"2020-01-{i % 9 + 1:02d}" for i in range(dates)] + ["x"] * (100 - dates))
    assert semantic(df) == {"c": type}
    assert (("c", "looks_datetime") in flags(df)) is flagged


@pytest.mark.parametrize("length, type", [(50, "categorical"), (51, "text")])
def test_mean_length_of_texts(spark, length, type):
    assert semantic(column_of(spark, ["a" * length, "b" * length] * 10)) == {"c": type}


def test_boolean_words_in_any_case(spark):
    assert semantic(column_of(spark, ["YES", "yes", "No"])) == {"c": "boolean"}
    assert semantic(column_of(spark, ["yes", "no", "n", "no", "no", "yes"])) == {"c": "categorical"}
    assert semantic(column_of(spark, ["yes", "maybe", "yes", "maybe"])) == {"c": "categorical"}


def test_native_types(spark):
    df = spark.sql("SELECT id % 2 = 0 AS b, DATE'2020-01-01' AS d, CAST(id AS DECIMAL(30, 2)) AS m, array(id) AS a, "
                   "map('k', id) AS k, CAST(NULL AS STRING) AS n, CAST(NULL AS DOUBLE) AS f FROM range(30)")
    assert semantic(df) == {"b": "boolean", "d": "datetime", "m": "numeric-continuous", "a": "unknown", "k": "unknown",
                            "n": "unknown", "f": "numeric-continuous"}
    distinct = {r["column"]: r["distinct"] for r in distinct_counts(df).collect()}
    assert distinct == {"b": 2, "d": 1, "m": 30, "a": 30, "k": 30, "n": 0, "f": 0}
    assert {(r["value"], r["n"]) for r in profile(df).top_values.where("column = 'b'").collect()} == {("true", 15), ("false", 15)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "a string, b int, t timestamp")
    result = profile(df)
    row = result.summary.first()
    assert (row["row_count"], row["column_count"], row["duplicate_count"], row["completeness"], row["flag_count"]) == (0, 3, 0, 100.0, 0)
    assert semantic(df) == {"a": "unknown", "b": "numeric-continuous", "t": "datetime"}
    assert result.categorical.first()["unique_count"] == 0
    assert result.numeric.first()["mean"] is None


def test_numeric_statistics_match_pandas(spark):
    rng = np.random.default_rng(5)
    values = pd.Series(np.exp(rng.normal(size=501)))
    row = profile(column_of(spark, values.tolist(), "double")).numeric.first()
    expected = [values.min(), values.max(), values.mean(), values.median(), values.std(), values.quantile(0.25),
                values.quantile(0.75), values.skew()]
    assert np.allclose(list(row)[1:], expected, rtol=1e-9)


def test_skewness_needs_three_values_and_is_zero_for_equal_ones(spark):
    assert profile(column_of(spark, [1.5, 2.5], "double")).numeric.first()["skewness"] is None
    assert profile(column_of(spark, [2.5] * 4, "double")).numeric.first()["skewness"] == 0.0


def test_top_values_keep_long_texts_whole(spark):
    long = "long text " * 50
    df = column_of(spark, [long] * 3 + ["b"] * 3 + ["a"] * 3 + ["#" + "0" * 64] * 2)
    top = [(r["value"], r["n"]) for r in profile(df).top_values.orderBy("rank").collect()]
    assert sorted(top) == sorted([(long, 3), ("a", 3), ("b", 3), ("#" + "0" * 64, 2)])


def test_duplicates_count_nulls_and_nan_as_equal(spark):
    df = spark.createDataFrame([(None, 1.0, "x" * 100), (None, 1.0, "x" * 100), ("a", float("nan"), None), ("a", float("nan"), None),
                                ("a", None, None)], "s string, d double, t string")
    assert duplicate_count(df).first()[0] == 3  # NaN counts as missing
    assert Dedupe().apply(df).count() == 2


def test_histogram_holds_every_filled_value(spark):
    df = messy(spark)
    counts = column_value_counts(df, ["shop", "note"]).groupBy("column").sum("n").collect()
    assert {r[0]: r[1] for r in counts} == {"shop": 40, "note": 1}


def test_result_does_not_depend_on_the_partitioning(spark):
    df = messy(spark)
    rows = lambda d: sorted(map(str, profile(d).stats.drop("mean", "std", "skewness").collect()))
    assert rows(df.repartition(1)) == rows(df.repartition(7))


@pytest.mark.parametrize("held", [10_000_000, 1])
def test_exact_quantiles_of_skewed_columns(spark, held):
    """With few values held in memory the brackets are narrowed over and over."""
    df = spark.range(0, 60_000, 1, 4).select(
        F.when(F.rand(2) < 0.4, F.lit(7.0)).otherwise(F.randn(3) * 50).alias("hot"),
        F.exp(F.randn(5) * 20).alias("tail"), F.when(F.col("id") % 3 == 0, F.rand(4)).alias("gaps"),
    )
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    found, extra = exact_quantiles(df, {c: F.col(c) for c in df.columns}, probs, [F.count(F.lit(1))], values_held=held)
    pdf = df.toPandas()
    assert extra[0] == 60_000
    for c in df.columns:
        assert np.allclose(found[c], pdf[c].quantile(probs), rtol=1e-12)


def test_quantiles_without_values(spark):
    df = column_of(spark, [None, None], "double")
    assert exact_quantiles(df, {"c": F.col("c")}, [0.5])[0] == {"c": [None]}


@pytest.mark.parametrize("freq", ["D", "3D", "h", "6h", "15min", "s", "W-SUN", "2W-WED", "MS", "ME", "QS-OCT", "QE-DEC", "YS-MAY", "YE-DEC", "2MS", "B"])
def test_frequency_names(spark, freq):
    moments = pd.date_range("2021-03-01 00:00", periods=30, freq=freq)
    df = spark.createDataFrame(pd.DataFrame({"t": moments})).repartition(3)
    assert infer_frequency(df, {"t": F.col("t")})["t"] == pd.infer_freq(moments)


@pytest.mark.parametrize("moments", [
    ["2021-01-01", "2021-01-02", "2021-01-03"],                  # too few
    ["2021-01-01", "2021-01-01", "2021-01-02", "2021-01-03"],    # one twice
    ["2021-01-01", "2021-01-03", "2021-01-03", "2021-01-07"],    # on a grid, but with one twice
    ["2021-01-15", "2021-02-15", "2021-03-15", "2021-04-15"],    # the middle of months
    ["2021-01-01", "2021-01-02", "2021-01-03", "2021-01-09"],
])
def test_irregular_dates_have_no_frequency(spark, moments):
    df = column_of(spark, [dt.datetime.fromisoformat(m) for m in moments], "timestamp")
    assert infer_frequency(df, {"c": F.col("c")}) == {"c": None}


def test_sample_rows(spark):
    df = spark.range(100).select("id", F.when(F.col("id") == 0, F.lit(math.nan)).otherwise(F.lit(1.0)).alias("v"))
    rows = sample_rows(df, ["id"], seed=3).collect()
    ids = {s: [r["id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["section"] == s] for s in ("first", "last", "random")}
    assert ids["first"] == [0, 1, 2, 3, 4] and ids["last"] == [99, 98, 97, 96, 95] and len(set(ids["random"])) == 5
    assert [r["v"] for r in rows if r["section"] == "first" and r["id"] == 0] == [None]
    assert {r["id"] for r in sample_rows(df.repartition(5), ["id"], seed=3).where("section = 'random'").collect()} == set(ids["random"])
    assert sample_rows(spark.range(3), ["id"]).count() == 9
