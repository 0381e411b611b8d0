"""Stored profiles: merging parts gives what the whole gives."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tablecare.operators.sketches import RANK_ERROR, TOP_ITEMS, merge_profiles, profile_figures, sketch_profile, store_profile, stored_profile

SCHEMA = "load string, n long, x double, `a.b` string, t timestamp, none double, ok boolean"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(rng.choice("abc"), rng.randrange(1000), rng.choice([rng.gauss(1e6, 3), None, float("nan"), float("inf"), -0.0, 0.0]), rng.choice(["x", " y", "12", "2020-01-02", None, "z" * rng.randrange(9)]), None, None, rng.random() < 0.3)
            for _ in range(3000)]
    return spark.createDataFrame(data, SCHEMA).withColumn("t", F.timestamp_seconds("n")).cache()


def figures(profiles):
    return {r["column"]: r.asDict(recursive=True) for r in profile_figures(profiles).collect()}


EXACT = ("kind", "pos", "rows", "non_null", "null_share", "min", "max", "number_share", "date_share", "mean_length", "padded")


def test_merged_parts_are_the_whole(rows):
    whole = figures(sketch_profile(rows))
    parts = sketch_profile(rows, F.col("load"))
    assert parts.count() == 3 * len(rows.columns)
    a = merge_profiles(parts.where("part != 'c'"), "ab")
    for merged in (merge_profiles(parts), merge_profiles(a.unionByName(parts.where("part = 'c'")))):
        got = figures(merged)
        assert got.keys() == whole.keys() == set(rows.columns)
        for name, row in got.items():
            assert {k: row[k] for k in EXACT} == {k: whole[name][k] for k in EXACT}
            for k in ("mean", "std", "skewness"):
                assert row[k] == whole[name][k] or row[k] == pytest.approx(whole[name][k], rel=1e-9, abs=1e-9)
    assert whole["none"]["non_null"] == 0 and whole["none"]["distinct"] == 0 and whole["none"]["median"] is None


def test_sketches_keep_their_bounds(rows):
    got = figures(merge_profiles(sketch_profile(rows, F.col("load"))))
    values = [r["n"] for r in rows.select("n").collect()]
    assert abs(got["n"]["distinct"] / len(set(values)) - 1) < 4 * 1.04 / math.sqrt(4096)
    for name, share in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        below = sum(v < got["n"][name] for v in values) / len(values), sum(v <= got["n"][name] for v in values) / len(values)
        assert below[0] - RANK_ERROR <= share <= below[1] + RANK_ERROR
    letters = [r["load"] for r in rows.select("load").collect()]
    assert {t["value"]: t["n"] for t in got["load"]["top"]} == pytest.approx({c: letters.count(c) for c in "abc"}, abs=3.5 / TOP_ITEMS * len(letters))


def test_a_stored_part_is_replaced(spark, rows, tmp_path):
    path = str(tmp_path / "profile")
    for part in "abc":
        store_profile(rows.where(F.col("load") == part), path, part)
    store_profile(rows.where("load = 'b'"), path, "b")
    merged = figures(merge_profiles(stored_profile(spark, path)))
    assert merged["n"]["rows"] == rows.count() and merged["n"]["mean"] == pytest.approx(figures(sketch_profile(rows))["n"]["mean"])


def test_an_empty_table_has_empty_figures(rows):
    parts = sketch_profile(rows.limit(0))
    assert parts.count() == 0 and merge_profiles(parts).count() == 0
