from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablecare import Plan, profile, propose, roll_up, to_plan, validate
from tablecare.operators.clean import (
    Clip, Dedupe, Derive, Drop, DropMissing, Fill, Head, MapLabels, Matches, MissingLabels, Rename, SnakeCase, SplitMixed,
    Strip, Title, ToNumber, ToTimestamp, Where, expression, label_spellings, names_in,
)
from tablecare.operators.validate import compare, row_count_status
from tablecare.plans.plan import RUN_ORDER
from tablecare.streaming.clean import clean_stream


def shop(spark):
    return spark.createDataFrame([
        (1, " Tea ", "3.5", 10.0, "2021-05-01"), (2, "tea", "x", None, "01/05/2021"), (3, "TEA", "4", 30.0, "later"),
        (4, "tea", None, 20.0, None), (5, "Milk", "7", float("nan"), "2021-05-03"), (6, None, "9", 1000.0, "05/13/2021"),
    ], "id int, item string, price string, amount double, day string")


def col(df, name, order="id"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_row_wise_steps(spark):
    df = shop(spark)
    assert col(Strip(["item"]).apply(df), "item") == ["Tea", "tea", "TEA", "tea", "Milk", None]
    assert col(Title(["item"]).apply(df), "item") == ["Tea", "Tea", "Tea", "Tea", "Milk", None]
    assert col(ToNumber(["price"]).apply(df), "price") == [3.5, None, 4.0, None, 7.0, 9.0]
    days = col(ToTimestamp(["day"]).apply(df), "day")
    assert days == [dt.datetime(2021, 5, 1), dt.datetime(2021, 1, 5), None, None, dt.datetime(2021, 5, 3), dt.datetime(2021, 5, 13)]
    split = SplitMixed(["price"]).apply(df)
    assert col(split, "price_raw") == [None, "x", None, None, None, None]
    assert Rename({"item": "what"}).apply(df).columns == ["id", "what", "price", "amount", "day"]
    assert Drop(["item", "day"]).apply(df).columns == ["id", "price", "amount"]
    assert col(Matches("hit", "item", "(?i)tea").apply(df), "hit") == [True, True, True, True, False, None]
    assert col(Where("amount > 10").apply(df), "id") == [3, 4, 5, 6]  # NaN is larger than any number
    assert col(Head(2, ["id"]).apply(df), "id") == [1, 2]
    assert col(Derive("double", "amount * 2").apply(df), "double")[0] == 20.0
    assert col(MissingLabels(["item"], ["milk"]).apply(df), "item")[4] is None


def test_fill(spark):
    df = shop(spark)
    assert col(Fill(["amount"]).apply(df), "amount") == [10.0, 25.0, 30.0, 20.0, 25.0, 1000.0]
    assert col(Fill(["amount"], "mean").apply(df), "amount")[1] == 265.0
    assert col(Fill(["item"], "mode").apply(df), "item")[5] == "tea"
    assert col(Fill(["amount"], "value", 0).apply(df), "amount")[1] == 0.0
    assert col(Fill(["price"], "value", "?").apply(df), "price")[3] == "?"


def test_fill_of_whole_numbers(spark):
    odd = spark.createDataFrame([(1, 1), (2, None), (3, 3)], "id int, n int")
    even = spark.createDataFrame([(1, 1), (2, None), (3, 4)], "id int, n int")
    assert Fill(["n"]).apply(odd).schema["n"].dataType.simpleString() == "int"
    assert col(Fill(["n"]).apply(even), "n") == [1.0, 2.5, 4.0]
    empty = spark.createDataFrame([(1, None)], "id int, n int")
    assert col(Fill(["n"]).apply(empty), "n") == [None]


def test_missing_rows_and_duplicates(spark):
    df = shop(spark)
    assert col(DropMissing(["amount"]).apply(df), "id") == [1, 3, 4, 6]
    assert col(DropMissing().apply(df), "id") == [1, 3]
    first = Dedupe(["price"], ["id"]).apply(spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (4, None)], "id int, price string"))
    assert col(first, "id") == [1, 2]
    assert Dedupe().apply(df.union(df)).count() == 6
    with pytest.raises(ValueError):
        Dedupe(["price"]).apply(df)


def test_clip_uses_quartiles(spark):
    df = shop(spark)
    values = col(Clip(["amount"]).apply(df), "amount")
    # quartiles of 10, 20, 30, 1000 are 17.5 and 272.5
    assert values == [10.0, None, 30.0, 20.0, None, 272.5 + 1.5 * 255.0]


def test_label_map_takes_the_most_frequent_spelling(spark):
    df = shop(spark)
    assert col(MapLabels("item").apply(df), "item") == ["tea", "tea", "tea", "tea", "Milk", None]
    row = label_spellings(df, ["item"]).collect()
    assert [(r["label"], r["spellings"], r["rows"], r["canonical"]) for r in row] == [("tea", 3, 4, "tea")]


def test_large_label_maps_are_not_broadcast(spark, monkeypatch):
    import tablecare.operators.joins as joins

    monkeypatch.setattr(joins.small_side, "__defaults__", (0,))
    mapped = MapLabels("item").apply(shop(spark))
    assert "BroadcastHint" not in mapped._jdf.queryExecution().logical().toString()
    assert col(mapped, "item") == ["tea", "tea", "tea", "tea", "Milk", None]


@pytest.mark.parametrize("op", [Strip(["item"]), Title(["item"]), ToNumber(["price"]), DropMissing(["amount"]),
                                Dedupe(["item"], ["id"]), MissingLabels(["item"]), MapLabels("item")])
def test_cleaning_twice_changes_nothing_more(spark, op):
    once = op.apply(shop(spark))
    twice = op.apply(once.select([F.col(c).cast("string") if c == "price" else F.col(c) for c in once.columns]))
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.select(once.columns).collect()))


def test_snake_case_of_a_table(spark):
    df = spark.range(1).select(F.lit(1).alias("Net Sum"), F.lit(2).alias("netSum"), F.lit(3).alias("net_sum_2"), F.lit(4).alias("%"))
    names = SnakeCase().apply(df).columns
    assert names[0] == "net_sum" and names[3] == "unnamed" and len(set(names)) == 4


def test_expressions_refuse_java_calls(spark):
    for sql in ("reflect('java.lang.System', 'exit', 0)", "1 + `java_method` ('a', 'b')", "TRY_REFLECT('a', 'b')"):
        with pytest.raises(ValueError):
            expression(sql)


def test_plan_order_screening_and_selection(spark):
    plan = Plan([Title(["item"], id="t"), Drop(["gone"], id="g"), Dedupe(id="d"), Rename({"item": "what"}, id="r"), Strip(["item"], id="s")])
    assert [op.id for op in plan.screen(shop(spark).columns).sorted().ops] == ["r", "s", "d", "t"]
    assert [op.id for op in plan.select(["d", "t"]).ops] == ["t", "d"]
    assert [op.id for op in plan.of_type("drop_column")] == ["g"]
    assert RUN_ORDER[0] == "rename_columns"


def test_plan_keeps_the_table_when_a_step_fails(spark):
    plan = Plan([Rename({"item": "What Is It"}, id="rename"), SnakeCase(id="snake"), Strip(["amount"], id="not_text"),
                 Derive("x", "nope + 1", id="unknown"), Title(["item"], id="title"), Fill(["amount"], "guess", id="bad_fill")])
    clean, log = plan.apply(shop(spark))
    assert clean.columns == ["id", "what_is_it", "price", "amount", "day"]
    assert col(clean, "what_is_it")[0] == "Tea"
    assert {r["id"]: r["status"] for r in log.collect()} == {
        "rename": "ok", "snake": "ok", "not_text": "skip", "unknown": "skip", "title": "ok", "bad_fill": "skip"}


def test_plan_measures_neighbouring_fills_together_and_after_a_shuffle(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, 4.0), (3, 3.0, 8.0), (3, 3.0, 8.0)], "id int, a double, b double")
    plan = Plan([Dedupe(["id"], ["id"], id="d"), Fill(["a"], id="a"), Fill(["b"], id="b"), Clip(["a"], id="c")])
    clean, log = plan.apply(df)
    assert col(clean, "a") == [1.0, 2.0, 3.0] and col(clean, "b") == [6.0, 4.0, 8.0]
    assert [r["status"] for r in log.orderBy("position").collect()] == ["ok"] * 4


def test_proposals_lead_to_a_clean_table(spark):
    rows = [(i, f" {['north', 'North', 'n/a'][i % 3]}", str(i % 5) if i % 6 else "?", None if i % 4 == 0 else 2.0 * (i % 9)) for i in range(60)]
    df = spark.createDataFrame(rows + rows[:3], "row_id int, area string, size string, weight double")
    proposals = {(r["type"], r["column"], r["how"]) for r in propose(profile(df)).collect()}
    assert proposals >= {("drop_duplicates", None, "rows"), ("fix_whitespace", "area", "strip"), ("fix_dtype", "size", "number"),
                         ("fill_missing", "weight", "median"), ("standardize_categories", "area", "title"),
                         ("fix_mixed_types", "area", "missing")}
    plan = to_plan(propose(profile(df)).collect())
    clean, log = plan.apply(df)
    assert {r["status"] for r in log.collect()} == {"ok"}
    assert clean.count() == 60 and clean.where("weight IS NULL").isEmpty()
    assert {r[0] for r in clean.select("area").distinct().collect()} == {"North", None}
    assert roll_up(validate(df, clean, plan)).first()["fails"] == 0


@pytest.mark.parametrize("before, after, status", [
    (0, 0, "PASS"), (100, 100, "PASS"), (100, 80, "PASS"), (100, 79, "WARNING"), (100, 50, "WARNING"), (100, 49, "FAIL"), (100, 101, "WARNING")])
def test_row_count_limits(spark, before, after, status):
    df = spark.createDataFrame([(before, after)], "b bigint, a bigint")
    assert df.select(row_count_status(F.col("b"), F.col("a"))).first()[0] == status


def checks(before, after, plan=None):
    return {r["name"]: r["status"] for r in validate(before, after, plan).collect()}


def test_validation_of_an_unchanged_table(spark):
    found = checks(shop(spark), shop(spark))
    assert set(found.values()) == {"PASS"} and {"row_count", "schema", "duplicates", "distribution_amount", "dtype_id"} <= set(found)
    assert roll_up(validate(shop(spark), shop(spark))).first()["status"] == "PASS"


def test_validation_findings(spark):
    before = spark.createDataFrame([(i, float(i % 5), 7.0, "a") for i in range(10)], "id int, x double, flat double, s string")
    after = before.select("id", (F.col("x") + 100).alias("x"), F.col("flat"), F.lit(1).alias("new"))
    after = after.union(after).withColumn("id", F.col("id").cast("string"))
    found = checks(before, after)
    assert found["schema"] == "FAIL" and found["row_count"] == "WARNING" and found["distribution_x"] == "WARNING"
    assert found["dtype_id"] == "WARNING" and found["duplicates"] == "PASS" and "distribution_flat" not in found
    plan = Plan([Drop(["s"]), Dedupe(), ToNumber(["id"])])
    excused = checks(before, after, plan)
    assert excused["schema"] == "PASS" and excused["duplicates"] == "WARNING" and "dtype_id" not in excused
    rolled = roll_up(validate(before, after)).first()
    assert (rolled["status"], rolled["fails"]) == ("FAIL", 1)


def test_validation_of_null_targets(spark):
    df = shop(spark)
    plan = Plan([Fill(["amount"]), DropMissing(["item", "gone"])])
    found = checks(df, Fill(["amount"]).apply(df), plan)
    assert found["nulls_amount"] == "PASS" and found["nulls_item"] == "WARNING" and "nulls_gone" not in found


def test_shift_of_exactly_the_limit_passes(spark):
    before = spark.createDataFrame([(-1.0,), (0.0,), (1.0,)], "x double")
    assert checks(before, before.selectExpr("x + 2.0 AS x"))["distribution_x"] == "PASS"
    assert checks(before, before.selectExpr("x + 2.001 AS x"))["distribution_x"] == "WARNING"


def test_compare(spark):
    found = {r["measure"]: (r["before"], r["after"]) for r in compare(shop(spark), Drop(["day"]).apply(shop(spark)), 1).collect()}
    assert found == {"rows": (6, 6), "columns": (5, 4), "nulls": (5, 4), "ops_applied": (None, 1)}


def test_row_wise_plan_on_a_stream(spark, tmp_path):
    shop(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(shop(spark).schema).parquet(str(tmp_path / "in"))
    plan = Plan([Strip(["item"]), ToNumber(["price"]), DropMissing(["item"])])
    query = clean_stream(stream, plan).writeStream.format("memory").queryName("cleaned").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r["item"] for r in spark.table("cleaned").collect()) == ["Milk", "TEA", "Tea", "tea", "tea"]
    with pytest.raises(ValueError):
        clean_stream(stream, Plan([Clip(["amount"])]))


def test_expressions_give_null_where_they_would_fail(spark):
    df = spark.createDataFrame([(1, "x", [1])], "a int, b string, c array<int>")
    plan = Plan([Derive("d", "CAST(b AS INT)"), Derive("e", "a / 0"), Derive("f", "c[7]"), Where("a / 0 IS NULL")])
    out, log = plan.apply(df)
    assert [tuple(r)[3:] for r in out.collect()] == [(None, None, None)] and {r["status"] for r in log.collect()} == {"ok"}
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_names_in_an_expression(spark):
    assert names_in("year > 2000 and date = '2020-01-01' and amount > 1 and `day` < current_date") == ["year", "date", "amount", "day"]
    assert names_in("aggregate(a, 0, (acc, x) -> acc + x.y + s.z, acc -> acc * b)") == ["a", "s", "b"]
    assert names_in("x -> x + 1 >") == [] and names_in("interval 1 day + day") == ["day"]
    assert names_in("sum(`a.b` * price) / count_if(status = 'open' AND NOT is_big)") == ["a.b", "price", "status", "is_big"]
    assert names_in("transform(items, x -> x + tax)") == ["items", "tax"] and names_in("CAST(b AS INT) IS NULL") == ["b"]


def test_labels_beside_columns_of_the_same_names(spark):
    df = spark.createDataFrame([("A", 1, 2), ("a", 1, 2), ("A", 3, 4)], "name string, label int, canonical int")
    assert sorted(tuple(r) for r in MapLabels("name").apply(df).collect()) == [("A", 1, 2), ("A", 1, 2), ("A", 3, 4)]


def test_counts_of_steps_cost_no_job(spark):
    df = spark.createDataFrame([(1, " a", "1"), (2, "b", "x"), (3, None, "3"), (4, "d", "7")], "id int, s string, n string").repartition(2)
    plan = Plan([Strip(["s"], id="strip"), ToNumber(["n"], id="number"), Derive("d", "nowhere + 1", id="none"), DropMissing(["s"], id="drop"), Rename({"s": "t"}, id="rename"),
                 Strip(["s"], id="again"), Where("id > 1", id="where"), Dedupe(id="equal"), Fill(["n"], how="median", id="fill")])

    def jobs(run):
        spark.sparkContext.setJobGroup(name := f"jobs {id(run)}", name)
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    held = []

    def observed():
        done, counts = plan.observed(df)
        done.collect()
        held.append(counts)

    assert jobs(lambda: plan.apply(df)[0].collect()) == jobs(observed)
    got = {r["id"]: (r["status"], r["rows_in"], r["rows_out"], r["changed"]) for r in held[0].frame().collect()}
    assert got == {"strip": ("ok", 4, 4, 1), "number": ("ok", 4, 4, 1), "none": ("skip", 4, 4, 0), "drop": ("ok", 4, 3, 0), "rename": ("ok", 3, 3, None), "again": ("ok", 3, 3, 0),
                   "where": ("ok", 3, 2, 0), "equal": ("ok", 2, 2, None), "fill": ("ok", 2, 2, 1)}
