"""Read tables: CSV with missing-value tokens, JSON, Parquet."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.operators.schema import column
from tablecare.sources import ranges

# Texts that stand for a missing value in a CSV file.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
CORRUPT = "__corrupt"
# Empty fields are read as empty texts, so that only fields that are not there are null.
NO_FIELD = "\x00no field\x00"
WIDE_TABLE = 500


# Spark hands some failures of file formats through as they are.
_FAILURES = (PySparkException, Py4JJavaError)


class SourceError(Exception):
    """A source that cannot be read, with the cause in words."""


def null_tokens(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Missing-value tokens of text columns as null."""
    return df.select(*[
        F.when(~column(f.name).isin(*tokens), column(f.name)).alias(f.name)
        if isinstance(f.dataType, T.StringType) else column(f.name)
        for f in df.schema.fields
    ])


def _csv(spark: SparkSession, encoding: str, multi_line: bool, sep: str):
    return (
        spark.read.option("header", True).option("sep", sep).option("escape", '"')
        .option("nullValue", NO_FIELD).option("emptyValue", "")
        .option("encoding", encoding).option("multiLine", multi_line).option("enforceSchema", False)
    )


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    *,
    encoding: str = "UTF-8",
    multi_line: bool = True,
    sep: str = ",",
    tokens: Sequence[str] = NULL_TOKENS,
) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)`` of a CSV file or folder with a header; every column stays text.

    Types are given later by explicit cleaning steps, so no pass is spent on
    guessing them. Rows with too few fields are filled up with nulls; ``(line)``
    of those with too many are the rejects. Files of one folder need the same
    header; another one is an error when read.

    Quotes may hold line breaks. Files are read range by range all the same
    (see ``ranges``), in encodings that have ASCII as it is and with line feeds
    (with or without a return before) between lines; a file in another encoding
    is read by one task. A first pass looks whether quotes hold line breaks; where
    none do, ``multi_line=False`` saves that pass.
    """
    try:
        header = _csv(spark, encoding, multi_line, sep).csv(path).columns
    except _FAILURES as error:
        raise SourceError(f"cannot read CSV {path}: {_cause(error)}") from error
    if not header:
        raise SourceError(f"no columns in CSV {path}: it lacks a header row")
    paths = [path] if isinstance(path, str) else path
    starts = None
    if multi_line and _ascii_inside(encoding) and len(sep) == 1:
        starts = ranges.starts(spark, paths, ranges.csv_grammar(sep))
        # without line breaks in quotes Spark's own reader cuts the files as well
        multi_line = not starts.where("spans").isEmpty()
    if starts is not None and multi_line:
        rows = _csv_ranges(spark, paths, header, encoding, sep, starts)
    else:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, CORRUPT]])
        rows = (
            _csv(spark, encoding, multi_line, sep)
            .option("columnPruning", False).option("columnNameOfCorruptRecord", CORRUPT).schema(schema).csv(path)
        )
    # a line that has too few fields lacks the last; one that has too many does not
    short = F.col(CORRUPT).isNotNull() & column(header[-1]).isNull()
    good, rejects = _split(rows.withColumn(CORRUPT, F.when(~short, F.col(CORRUPT))))
    return null_tokens(good, tokens), rejects


def _ascii_inside(encoding: str) -> bool:
    """Is every ASCII byte of a text in this encoding that ASCII character, and no part of another?"""
    name = encoding.lower().replace("_", "-")
    return name in ("utf-8", "utf8", "us-ascii", "ascii", "latin1") or name.startswith(("iso-8859-", "windows-125", "cp125"))


def _csv_ranges(
    spark: SparkSession, paths: Sequence[str], header: Sequence[str], encoding: str, sep: str, starts: DataFrame
) -> DataFrame:
    """The columns of *header* and the text of lines that do not fit it, of files that are read range by range."""
    found = ranges.records(spark, paths, ranges.csv_grammar(sep), starts)
    text = F.col("record").cast("string") if _utf8(encoding) else F.decode("record", encoding)
    lines = found.select(F.regexp_replace(text, r"\r\z", "").alias("line"), "first").where(F.col("line") != "")
    names = [f"c{i}" for i in range(len(header))]
    options = {
        "sep": sep, "escape": '"', "nullValue": NO_FIELD, "emptyValue": "", "columnNameOfCorruptRecord": CORRUPT, "multiLine": "true",
    }
    fields = F.from_csv("line", ", ".join(f"{n} string" for n in [*names, CORRUPT]), options)
    rows = lines.select(fields.alias("f"), "first")
    # a name that the header has twice was made unique, and an empty one was made up
    own = [F.lower(F.col(f"f.{n}")).eqNullSafe(F.lit(c.lower())) | F.col(f"f.{n}").isin("") | F.lit(_made(c, header))
           for n, c in zip(names, header)]
    same = reduce(lambda x, y: x & y, own) & F.col(f"f.{CORRUPT}").isNull()
    wrong = F.raise_error(F.lit(f"a CSV file below {paths[0]} has another header than {list(header)}")).cast("boolean")
    body = rows.where(F.when(F.col("first"), F.when(same, F.lit(False)).otherwise(wrong)).otherwise(F.lit(True)))
    return body.select(*[F.col(f"f.{n}").alias(c) for n, c in zip(names, header)], F.col(f"f.{CORRUPT}").alias(CORRUPT))


def _utf8(encoding: str) -> bool:
    return encoding.lower().replace("_", "-") in ("utf-8", "utf8")


def _made(name: str, header: Sequence[str]) -> bool:
    """Could Spark have made this name up, for a header cell that is empty or there twice?"""
    return name.startswith("_c") or any(c != name and name.lower().startswith(c.rstrip("0123456789").lower()) and name[-1:].isdigit() for c in header)


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the lines that did not parse.

    Spark does not read the corrupt-record column alone, so the test for it
    looks at another column as well.
    """
    with_others = F.length(F.coalesce(column(rows.columns[0]).cast("string"), F.lit(""))) >= 0
    bad = F.col(CORRUPT).isNotNull() & with_others
    good = rows.where(F.col(CORRUPT).isNull() & with_others).drop(CORRUPT)
    return good, rows.where(bad).select(F.col(CORRUPT).alias("line"))


def read_json(
    spark: SparkSession, path: str | list[str], *, lines: bool = False, schema: str | T.StructType | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)`` of JSON: an array of objects per file (or one object), or one object per line.

    Give a *schema* for large data; without one Spark reads it all to infer it, an array by one task.
    With one, array files are read range by range (see ``ranges``): an element that is no object, does
    not fit or is cut off by the end of its file is a reject, the others are rows.
    """
    reader = spark.read.option("multiLine", not lines)
    try:
        if schema is None:
            schema = reader.option("columnNameOfCorruptRecord", CORRUPT).json(path).schema
    except _FAILURES as error:
        raise SourceError(f"cannot read JSON {path}: {_cause(error)}") from error
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = [f for f in wanted.fields if f.name != CORRUPT]
    if not fields:
        raise SourceError(f"cannot read JSON {path}: no array of objects")
    full = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])
    if lines:
        rows = reader.option("columnNameOfCorruptRecord", CORRUPT).schema(full).json(path)
    else:
        rows = _json_ranges(spark, [path] if isinstance(path, str) else path, full)
    return _split(rows)


def _json_ranges(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> DataFrame:
    grammar = ranges.json_grammar()
    found = ranges.records(spark, paths, grammar, ranges.starts(spark, paths, grammar))
    text = F.col("record").cast("string")
    # the array's own signs around its elements
    element = F.regexp_replace(F.concat(text, F.when(F.col("whole"), F.lit("}")).otherwise(F.lit(""))), r"\A\s*[\[,]?\s*|\s+\z", "")
    rest = F.regexp_replace(element, r"\s*\]?\z", "")
    # numbers, texts and the like before an object end nowhere by themselves
    plain = F.regexp_extract(element, r'(?s)\A((?:[^{\["]|"[^"\\]*+(?:\\.[^"\\]*+)*+")*+)\{', 1)
    parts = F.array(F.regexp_replace(plain, r"[\s,]+\z", ""), F.substr(element, F.length(plain) + 1))
    split = found.select(F.explode(F.when(F.col("whole"), parts).otherwise(F.array(rest))).alias("text"), "whole")
    texts = split.where(F.col("text") != "")
    parsed = F.from_json("text", schema, {"columnNameOfCorruptRecord": CORRUPT})
    rows = texts.select(F.when(F.col("whole"), parsed).alias("f"), "text")
    # what is cut off is a reject even if its beginning makes sense
    corrupt = F.when(F.col("f").isNull(), F.col("text")).otherwise(F.col(f"f.{CORRUPT}"))
    return rows.select(*[F.col("f")[f.name].alias(f.name) for f in schema.fields if f.name != CORRUPT], corrupt.alias(CORRUPT))


def read_json_columns(spark: SparkSession, path: str | list[str], columns: Sequence[str]) -> DataFrame:
    """JSON of the form ``{column: {row label: value}}``, as texts with ``row_label``.

    Cells are spread into rows and brought together per row label.
    """
    names = F.array(*[F.lit(c) for c in columns])
    cells = (
        spark.read.text(path, wholetext=True)
        .select(F.input_file_name().alias("__file"),
                F.explode(F.from_json("value", "map<string, map<string, string>>")).alias("column", "cells"))
        .where(F.array_contains(names, F.col("column")))
        .select("__file", "column", F.explode("cells").alias("row_label", "value"))
    )
    return cells.groupBy("__file", "row_label").agg(
        *[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns]
    ).drop("__file")


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Parquet files; an unreadable one is an error, never left out silently."""
    try:
        return spark.read.parquet(*([path] if isinstance(path, str) else path))
    except _FAILURES as error:
        raise SourceError(f"cannot read Parquet {path}: {_cause(error)}") from error


def _cause(error: Exception) -> str:
    return str(error).splitlines()[0]


def check_table(df: DataFrame) -> list[str]:
    """Warnings about an unusually small or wide table; an error without columns or rows.

    At most two rows are read.
    """
    if not df.columns:
        raise SourceError("the table has no columns")
    rows = df.limit(2).count()
    if rows == 0:
        raise SourceError("the table has a header but no rows")
    warnings = []
    if rows == 1:
        warnings.append("only one row")
    if len(df.columns) > WIDE_TABLE:
        warnings.append(f"{len(df.columns)} columns")
    return warnings
