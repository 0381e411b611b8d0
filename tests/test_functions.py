from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tablecare.functions import missing_to_null, parse_number, parse_timestamp, period_label, snake, strip, title, whole_days
from tablecare.functions.dates import format_shape


def values(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_strip_takes_every_kind_of_white_space(spark):
    texts = [" a ", "\ta\n", " a ", "a b", "", None]
    assert values(spark, texts, strip) == [t.strip() if t is not None else None for t in texts]


def test_title_starts_at_every_run_of_letters(spark):
    texts = ["mary o'hara", "x-RAY 7up", "ÉCOLE élève", "already Fine", "4th-street", None]
    assert values(spark, texts, title) == [t.title() if t is not None else None for t in texts]


def test_number_forms(spark):
    good = {"7": 7.0, " -3.50 ": -3.5, "+.5": 0.5, "2.": 2.0, "6E-2": 0.06, "\t8": 8.0}
    bad = ["", "5d", "1,5", "NaN", "inf", "0x1F", "--1", "1 2", "."]
    assert values(spark, list(good), parse_number) == list(good.values())
    assert values(spark, [*bad, None], parse_number) == [None] * (len(bad) + 1)


def test_dates_follow_the_declared_order(spark):
    texts = ["2021-03-04", "03/04/2021", "25/12/2021", " 2021-03-04 05:06:07 ", "2021-03-04T05:06:07", "2021-02-30", "soon", "2021"]
    march = dt.datetime(2021, 3, 4)
    late = dt.datetime(2021, 3, 4, 5, 6, 7)
    assert values(spark, texts, parse_timestamp) == [march, march, dt.datetime(2021, 12, 25), late, late, None, None, None]
    day_first = lambda c: parse_timestamp(c, ["dd/MM/yyyy"])
    assert values(spark, ["03/04/2021"], day_first) == [dt.datetime(2021, 4, 3)]


def test_formats_with_unknown_fields_are_not_guarded(spark):
    assert format_shape("yyyy-MM-dd a") is None
    shape = re.compile(format_shape("yyyy-MM-dd'T'HH"))
    assert shape.match("2020-12-31T23") and not any(map(shape.match, ["2020-13-31T23", "2020-12-32T23", "2020-12-31T24", "2020-12-31 23"]))
    assert values(spark, ["5 Jan 2020"], lambda c: parse_timestamp(c, ["d MMM yyyy"])) == [dt.datetime(2020, 1, 5)]


@pytest.mark.parametrize("name, expected", [
    ("Unit Price", "unit_price"), ("shipDate", "ship_date"), ("HTTPServer", "http_server"), ("item2Code", "item2_code"),
    ("A/B & C", "a_b_c"), ("rate %", "rate"), ("\tTab\nName ", "tab_name"), ("2nd_value", "col_2nd_value"), ("99", "col_99"),
    ("", "unnamed"), ("  ", "unnamed"), ("#!?", "unnamed"), ("naïve", "na_ve"), ("TOTAL", "total"), ("a__b", "a_b"), ("__x__", "x"),
])
def test_snake(spark, name, expected):
    assert values(spark, [name], snake) == [expected]


def test_missing_labels(spark):
    assert values(spark, ["N/A", " na ", "n/a", "nab", "", None], missing_to_null) == [None, None, None, "nab", "", None]


def test_period_labels(spark):
    df = spark.sql("SELECT explode(array(DATE'2024-02-10', DATE'2024-02-11', DATE'2024-02-12')) AS d")
    weeks = [r[0] for r in df.select(period_label(F.col("d"), "week")).collect()]
    assert weeks == [dt.date(2024, 2, 11), dt.date(2024, 2, 11), dt.date(2024, 2, 18)]
    assert df.select(period_label(F.col("d"), "month")).first()[0] == dt.date(2024, 2, 29)


def test_whole_days_round_down_on_both_sides(spark):
    df = spark.sql("SELECT TIMESTAMP'2024-01-02 12:00:00' AS a, TIMESTAMP'2024-01-05 11:00:00' AS b")
    assert df.select(whole_days(F.col("a"), F.col("b")), whole_days(F.col("b"), F.col("a"))).first() == (2, -3)
