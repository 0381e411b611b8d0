from __future__ import annotations

import json

import pytest

from tablecare.scratch import new_path
from tablecare.sources import (
    SourceError, check_table, encodings, load_summary, manifest, read_csv, read_csv_files, read_json, read_json_columns,
    read_parquet, write_csv,
)


def put(folder, name, content):
    path = folder / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_csv_stays_text_and_knows_missing_values(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'id,note\n1,N/A\n2,na\n3,\n4,"NULL"\n5, x \n6,"a ""b"", c"\n')
    df = read_csv(spark, path)[0]
    assert dict(df.dtypes) == {"id": "string", "note": "string"}
    assert [r["note"] for r in df.orderBy("id").collect()] == [None, "na", None, None, " x ", 'a "b", c']


def test_csv_with_line_breaks_in_quotes(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'id,note\n1,"two\nlines"\n')
    assert read_csv(spark, path)[0].first()["note"] == "two\nlines"


def test_csv_edges(spark, tmp_path):
    header = read_csv(spark, put(tmp_path, "h.csv", "x,y\n"))[0]
    assert header.columns == ["x", "y"] and header.count() == 0
    with pytest.raises(SourceError):
        check_table(header)
    with pytest.raises(SourceError):
        read_csv(spark, put(tmp_path, "e.csv", ""))
    with pytest.raises(SourceError):
        read_csv(spark, str(tmp_path / "nowhere.csv"))
    assert check_table(read_csv(spark, put(tmp_path, "o.csv", "x\n1\n"))[0]) == ["only one row"]
    wide = ",".join(f"c{i}" for i in range(501))
    assert check_table(read_csv(spark, put(tmp_path, "w.csv", f"{wide}\n{wide}\n{wide}\n"))[0]) == ["501 columns"]


def test_csv_rows_that_do_not_fit(spark, tmp_path):
    good, rejects = read_csv(spark, put(tmp_path, "a.csv", "x,y\n1,2\n3,4,5\n6,7\n"))
    assert good.count() == 2 and [r["line"] for r in rejects.collect()] == ["3,4,5"] and rejects.count() == 1


def test_csv_files_with_another_header_are_an_error(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, "a.csv", "x,y\n1,2\n")
    put(folder, "b.csv", "y,x\n3,4\n")
    with pytest.raises(Exception):
        read_csv(spark, str(folder))[0].collect()


def test_json_arrays_lines_and_columns(spark, tmp_path):
    rows = [{"a": i, "b": f"t{i}"} for i in range(3)]
    good, rejects = read_json(spark, put(tmp_path, "array.json", json.dumps(rows)))
    assert good.count() == 3 and rejects.count() == 0
    good, rejects = read_json(spark, put(tmp_path, "lines.json", '{"a": 1}\n{"a": \n{"a": 2}\n'), lines=True)
    assert sorted(r["a"] for r in good.collect()) == [1, 2] and [r["line"] for r in rejects.collect()] == ['{"a": ']
    with pytest.raises(SourceError):
        read_json(spark, put(tmp_path, "bad.json", "{not json"))
    table = read_json_columns(spark, put(tmp_path, "cols.json", '{"a": {"0": "1", "1": "2"}, "b": {"1": "y"}}'), ["a", "b"])
    assert sorted(tuple(r) for r in table.collect()) == [("0", "1", None), ("1", "2", "y")]


def test_parquet_errors(spark, tmp_path):
    with pytest.raises(SourceError):
        read_parquet(spark, put(tmp_path, "bad.parquet", "no parquet at all"))


def test_manifest(spark, tmp_path):
    put(tmp_path, "a.csv", "x\n1\n")
    put(tmp_path, "B.JSON", "[]")
    put(tmp_path, "mislabelled.xlsx", b"\xd0\xcf\x11\xe0rest")
    put(tmp_path, "plain.xls", "no signature")
    put(tmp_path, "noext", b"PAR1data")
    put(tmp_path, "what.txt", "text")
    put(tmp_path, "big.csv", "x" * 200)
    found = {r["path"].rsplit("/", 1)[1]: (r["format"], r["reason"]) for r in manifest(spark, str(tmp_path), max_bytes=100).collect()}
    assert found == {"a.csv": ("csv", None), "B.JSON": ("json", None), "mislabelled.xlsx": ("xls", None), "plain.xls": ("xls", None),
                     "noext": ("parquet", None), "what.txt": (None, "unsupported"), "big.csv": ("csv", "too large")}


def test_encodings_are_told_apart(spark, tmp_path):
    utf8 = put(tmp_path, "u.csv", "x,y\n漢字,1\n")
    latin = put(tmp_path, "l.csv", "x,y\nÅngström,2\n".encode("latin-1"))
    windows = put(tmp_path, "w.csv", "x,y\n“5 €”,3\n".encode("cp1252"))
    found = {r["path"].rsplit("/", 1)[1]: r["encoding"] for r in encodings(spark, [utf8, latin, windows]).collect()}
    assert found == {"u.csv": "UTF-8", "l.csv": "ISO-8859-1", "w.csv": "windows-1252"}
    rows = read_csv_files(spark, [utf8, latin, windows])[0].orderBy("y").collect()
    assert [r["x"] for r in rows] == ["漢字", "Ångström", "“5 €”"]


def test_write_and_summarise(spark, tmp_path):
    df = spark.createDataFrame([(1, " a ", [1, 2]), (2, 'q"uo,te', None)], "id int, t string, l array<int>")
    path = str(tmp_path / "out")
    write_csv(df, path)
    back = read_csv(spark, path)[0].orderBy("id").collect()
    assert [tuple(r) for r in back] == [("1", " a ", "[1,2]"), ("2", 'q"uo,te', None)]
    row = load_summary(spark, path, "csv", df).first()
    assert (row["format"], row["rows"], row["columns"]) == ("csv", 2, 3) and row["files"] >= 1


def test_scratch_folder_is_the_one_the_cluster_names():
    class Session:
        conf = {"spark.checkpoint.dir": "hdfs://shared/checkpoints/"}

    assert new_path(Session(), "x").startswith("hdfs://shared/checkpoints/x-")


def test_csv_short_rows_are_kept_and_nothing_is_lost(spark, tmp_path):
    good, rejects = read_csv(spark, put(tmp_path, "a.csv", 'x,y,z\n1,2,3\n4\n5,\n6,"a\nb",\n7,8,9,10\n,,\n'))
    assert sorted((tuple(r) for r in good.collect()), key=str) == sorted(
        [("1", "2", "3"), ("4", None, None), ("5", None, None), ("6", "a\nb", None), (None, None, None)], key=str)
    assert [r["line"] for r in rejects.collect()] == ["7,8,9,10"]


def test_csv_keeps_microseconds_and_binary(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.sql("SELECT timestamp'2024-01-01 00:09:58.778549' AS a, timestamp'2024-01-01 00:09:58' AS b, X'00FF' AS c, CAST(NULL AS timestamp) AS d")
    write_csv(df, path)
    assert tuple(read_csv(spark, path)[0].first()) == ("2024-01-01 00:09:58.778549", "2024-01-01 00:09:58", "00FF", None)
