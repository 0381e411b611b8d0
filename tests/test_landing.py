"""Landing folders: loads with restarts, headers of files, broken Parquet files."""

from __future__ import annotations

import json

import pytest

from tablecare.operators.clean import Fill, ToNumber, Where
from tablecare.plans.plan import Plan
from tablecare.sources import broken_parquet, manifest, read_parquet_files
from tablecare.sources.landing import ends_of
from tablecare.sources.readers import SourceError
from tablecare.streaming.landing import Landing

PLAN = Plan([ToNumber(["v"]), Where("v > 1")])


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("k,v\n" + "".join(f"{k},{v}\n" for k, v in rows))


def test_a_batch_that_is_cut_off_is_done_again(spark, tmp_path):
    source = tmp_path / "in"
    landing = Landing(str(source), str(tmp_path / "out"), PLAN, profile=True)
    put(source, "a.csv", [("a", 1), ("b", 2)])
    landing.run(spark)
    put(source, "b.csv", [("c", 3), ('"d', '\n"', 4)[:2], ("e", "x")])
    put(source, "c.csv", [("f", "5,6"), ("g", 7)])
    told = []

    def fail(batch):
        told.append(batch)
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        landing.run(spark, done=fail)
    landing.run(spark, done=told.append)
    landing.run(spark, done=told.append)
    assert told == [1, 1]
    assert sorted((r["k"], r["v"], r["batch"]) for r in landing.rows(spark).collect()) == [("b", 2.0, 0), ("c", 3.0, 1), ("g", 7.0, 1)]
    assert [(r["line"], r["batch"]) for r in landing.rejects(spark).collect()] == [("f,5,6", 1)]
    assert sorted(map(tuple, landing.log(spark).collect())) == [(0, 1, 0), (1, 3 - 1, 1)]


def test_small_batches_and_other_formats(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(5):
        (source / f"{i}.json").write_text(json.dumps([{"k": i, "v": j} for j in range(3)]))
    landing = Landing(str(source), str(tmp_path / "out"), PLAN.select([]), fmt="json", schema="k bigint, v bigint", files_per_batch=2)
    landing.run(spark)
    assert sorted((r["k"], r["v"]) for r in landing.rows(spark).collect()) == [(i, j) for i in range(5) for j in range(3)]
    assert landing.log(spark).count() == 3


def test_steps_over_the_whole_table_are_refused(spark, tmp_path):
    put(tmp_path / "in", "a.csv", [("a", 1)])
    with pytest.raises(Exception, match="not row-wise"):
        Landing(str(tmp_path / "in"), str(tmp_path / "out"), Plan([Fill(["v"], how="mode")])).run(spark)


def test_a_header_costs_a_few_bytes(spark, tmp_path):
    with open(tmp_path / "sparse", "wb") as f:
        f.write(b"PAR1")
        f.truncate(1 << 30)
    (tmp_path / "tiny").write_bytes(b"PK")
    (tmp_path / "book.xls").write_bytes(b"PK\x03\x04 rest")
    got = {r["path"].rsplit("/", 1)[1]: (r["length"], r["format"], r["reason"]) for r in manifest(spark, str(tmp_path)).collect()}
    assert got == {"sparse": (1 << 30, "parquet", None), "tiny": (2, None, "unsupported"), "book.xls": (9, "xlsx", None)}


def test_file_systems_that_only_spark_knows(spark, tmp_path, monkeypatch):
    (tmp_path / "a").write_bytes(b"0123456789abcdef")
    files = spark.read.format("binaryFile").load(str(tmp_path)).selectExpr("replace(path, 'file:', 'nosuch:') AS path", "length")
    with pytest.raises(Exception):  # Spark does not know it either
        ends_of(files).collect()
    known = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "length")
    assert [(bytes(r["head"]), bytes(r["tail"])) for r in ends_of(known).collect()] == [(b"01234567", b"89abcdef")]


def test_broken_parquet_files_are_rejects(spark, tmp_path):
    path = tmp_path / "t"
    spark.range(300).repartition(4).write.parquet(str(path))
    files = sorted(path.glob("*.parquet"))
    whole = files[0].read_bytes()
    kept = spark.read.parquet(*map(str, files[1:])).count()
    files[0].write_bytes(whole[:-20])
    (path / "x.parquet").write_bytes(b"PAR1")
    (path / "y.parquet").write_bytes(b"PAR1" + b"\xff\xff\xff\x7fPAR1")
    (path / "z.parquet").write_bytes(b"words and words PAR1")
    rows, rejects = read_parquet_files(spark, str(path))
    assert rows.count() == kept
    assert {r["path"].rsplit("/", 1)[1][:1] + ": " + r["reason"] for r in rejects.collect()} == {
        "p: cut off", "x: too short", "y: footer longer than the file", "z: does not begin as Parquet"}
    for f in files[1:]:
        f.write_bytes(b"PAR1")
    with pytest.raises(SourceError):
        read_parquet_files(spark, str(path))
    assert broken_parquet(spark, str(path)).count() == 7
