"""Files that are read range by range: the rows do not depend on where the ranges are cut."""

from __future__ import annotations

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from tablecare.sources import read_csv, read_json
from tablecare.sources.readers import SourceError


@pytest.fixture()
def cut(spark):
    """Sets the size of ranges."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in keys}

    def set_size(size: int) -> None:
        spark.conf.set(keys[0], size)
        spark.conf.set(keys[1], 1)
        spark.conf.set(keys[2], 1)

    yield set_size
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


ROWS = [("1", "a\nb"), ("2", 'x"y\n\n'), ("3", "é"), ("4", '\n,",\n'), ("5", 'p"q'), ("6", "open\nto the end")]
SMALL = '1,"a\nb"\n2,"x""y\n\n"\n"3",é\n4,"\n,"",\n"\n5,p"q\n6,"open\nto the end'


def test_a_cut_at_every_offset_of_a_small_csv(spark, cut, tmp_path):
    size = 29
    for i in range(size):  # what stands before moves the cuts
        (tmp_path / f"{i}.csv").write_text(f"k,v\n{i + 10},{'x' * (i + 1)}\n{SMALL}")
    cut(size)
    good, rejects = read_csv(spark, str(tmp_path), tokens=())
    rows = sorted((k, v.lstrip('"') if k == "6" else v) for k, v in good.collect())
    assert rows == sorted(ROWS * size + [(str(i + 10), "x" * (i + 1)) for i in range(size)]) and rejects.isEmpty()


def test_a_large_csv_in_many_ranges(spark, cut, tmp_path):
    rng = random.Random(1)
    rows = [[str(i), "\n".join("".join(rng.choice('ab ,"\'é\n') for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(1, 5))), str(rng.random())] for i in range(6_000)]
    for name, part in (("a", rows[:4_500]), ("b", rows[4_500:])):
        with open(tmp_path / f"{name}.csv", "w", newline="") as f:
            csv.writer(f, lineterminator="\n").writerows([["k", "text", "x"], *part])
    cut(40_000)
    good, rejects = read_csv(spark, str(tmp_path), tokens=("",))
    assert sorted(tuple(r) for r in good.collect()) == sorted(tuple(r) for r in rows) and rejects.isEmpty()


def test_one_record_over_many_ranges(spark, cut, tmp_path):
    text = "line\n" * 60
    (tmp_path / "a.csv").write_text(f'k,v\n1,"{text}"\n2,"{text}"\n3,x\n')
    cut(64)
    assert {tuple(r) for r in read_csv(spark, str(tmp_path / "a.csv"))[0].collect()} == {("1", text), ("2", text), ("3", "x")}


def test_encodings_blank_lines_and_another_separator(spark, cut, tmp_path):
    (tmp_path / "a.csv").write_bytes('k;v\n\n1;"é\n;"\n\n2;ü\n'.encode("latin-1"))
    cut(7)
    good, _ = read_csv(spark, str(tmp_path / "a.csv"), encoding="ISO-8859-1", sep=";")
    assert {tuple(r) for r in good.collect()} == {("1", "é\n;"), ("2", "ü")}
    (tmp_path / "b.csv").write_bytes('﻿k,v\n1,"é\n"\n'.encode())
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "b.csv"))[0].collect()] == [("1", "é\n")]


def test_another_header_in_a_folder_is_an_error(spark, cut, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,2\n")
    (tmp_path / "b.csv").write_text("k,w\n1,2\n")
    with pytest.raises(Exception, match="FAILED_READ_FILE"):  # by Spark's reader, as each line is a record
        read_csv(spark, str(tmp_path))[0].collect()
    (tmp_path / "a.csv").write_text('k,v\n1,"2\n"\n')
    with pytest.raises(Exception, match="another header"):
        read_csv(spark, str(tmp_path))[0].collect()
    with pytest.raises(SourceError):
        read_csv(spark, str(tmp_path / "none.csv"))


SCHEMA = "a bigint, b string, c struct<d: array<struct<e: bigint>>>"


def objects(n: int) -> list[dict]:
    rng = random.Random(2)
    return [{"a": i, "b": rng.choice(["x", 'q"}', "\\", "{[", '\\"', "é", "}{", "\\\\", ""]), "c": {"d": [{"e": i}, {"e": None}]}} for i in range(n)]


def read(spark, path):
    good, rejects = read_json(spark, str(path), schema=SCHEMA)
    rows = [{"a": r["a"], "b": r["b"], "c": {"d": [{"e": x["e"]} for x in r["c"]["d"]]}} for r in good.collect()]
    return sorted(rows, key=lambda r: r["a"]), [r["line"] for r in rejects.collect()]


def test_a_cut_at_every_offset_of_a_small_array(spark, cut, tmp_path):
    size = 47
    for i in range(size):
        (tmp_path / f"{i}.json").write_text(" " * i + json.dumps(objects(3), indent=i % 2 or None, ensure_ascii=False))
    cut(size)
    assert read(spark, tmp_path) == (sorted(objects(3) * size, key=lambda r: r["a"]), [])


def test_a_large_array_in_many_ranges_and_a_cut_off_one(spark, cut, tmp_path):
    (tmp_path / "x").mkdir()
    text = json.dumps(objects(5_000))
    (tmp_path / "x" / "a.json").write_text(text)
    cut(20_000)
    assert len(spark.read.option("lineSep", "}").text(str(tmp_path / "x")).select(F.spark_partition_id().alias("p")).distinct().collect()) > 10
    assert read(spark, tmp_path / "x") == (objects(5_000), [])
    (tmp_path / "b.json").write_text(text[:-30])
    rows, rejects = read(spark, tmp_path / "b.json")
    assert rows == objects(4_999) and len(rejects) == 1 and rejects[0].startswith('{"a": 4999')


def test_elements_that_are_no_objects(spark, cut, tmp_path):
    first, last = (json.dumps(x) for x in objects(2))
    (tmp_path / "a.json").write_text(f'[ 7, "}}", {first}, [1], {last}, null ]')
    (tmp_path / "b.json").write_text("[]")
    (tmp_path / "c.json").write_text(json.dumps(objects(3)[2]))
    cut(9)
    rows, rejects = read(spark, tmp_path)
    assert sorted(rejects) == sorted(['7, "}"', f"[1], {last}", "null"]) or sorted(rejects) == sorted(['7, "}"', "[1]", "null"])
    assert rows[0] == objects(1)[0] and rows[-1] == objects(3)[2]


def test_compressed_files_are_read_too(spark, cut, tmp_path):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([["k", "v"], ["1", "a\nb"]])
    spark.createDataFrame([(out.getvalue().rstrip("\n"),)], "value string").coalesce(1).write.option("compression", "gzip").text(str(tmp_path / "g"))
    spark.createDataFrame([(json.dumps(objects(5)),)], "value string").coalesce(1).write.option("compression", "gzip").text(str(tmp_path / "j"))
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "g"))[0].collect()] == [("1", "a\nb")]
    assert read(spark, tmp_path / "j") == (objects(5), [])


def test_a_csv_without_line_breaks_in_quotes_needs_no_second_look(spark, cut, tmp_path):
    spark.range(1000).select(F.col("id").cast("string").alias("k"), F.lit("x, y").alias("v")).write.option("header", True).csv(str(tmp_path / "n"))
    cut(500)
    good, rejects = read_csv(spark, str(tmp_path / "n"), multi_line=False)
    again, _ = read_csv(spark, str(tmp_path / "n"))
    assert good.count() == again.count() == 1000 and rejects.isEmpty() and again.exceptAll(good).isEmpty()


def test_returns_in_quotes_are_no_ends(spark, cut, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'k,v\r\n1,"a\rb"\r\n2,c\r\n')
    assert {tuple(r) for r in read_csv(spark, str(tmp_path / "a.csv"))[0].collect()} == {("1", "a\rb"), ("2", "c")}
