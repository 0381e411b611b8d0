"""A landing folder: which files are there, what they are, and how to read them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecare.operators.schema import column
from tablecare.scratch import new_path, ship_package
from tablecare.sources.readers import SourceError, read_csv, read_parquet

# Formats, and the first bytes that tell a format.
SUPPORTED = ("csv", "xlsx", "xls", "json", "parquet")
OFFICE = ("xlsx", "xls")
SIGNATURES = (("504B0304", "xlsx"), ("D0CF11E0", "xls"), ("50415231", "parquet"))


def extension(path: Column) -> Column:
    """The lower-case file extension, empty when there is none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def signature_format(head: Column) -> Column:
    """The format told by the first bytes (in hex), or null."""
    return F.coalesce(*[F.when(head.startswith(bytes_), F.lit(fmt)) for bytes_, fmt in SIGNATURES])


def format_of(ext: Column, signature: Column) -> Column:
    """A supported extension wins, save that first bytes decide between Office
    formats; without one the first bytes decide; null if neither is known."""
    office = ext.isin(*OFFICE) & signature.isin(*OFFICE)
    return F.when(office, signature).when(ext.isin(*SUPPORTED), ext).otherwise(signature)


def manifest(spark: SparkSession, folder: str, max_bytes: int | None = None) -> DataFrame:
    """``(path, length, format, reason)`` of all files below *folder*.

    *reason* is null, ``too large`` or ``unsupported``. Spark lists no empty
    files. The listing reads names and sizes only; of files whose extension does
    not settle the format, and that are not above the limit, tasks read the first bytes.
    """
    max_bytes = 2**63 - 1 if max_bytes is None else max_bytes
    listed = _files(spark, folder).select("path", "length", extension(F.col("path")).alias("ext"))
    settled = F.col("ext").isin(*[e for e in SUPPORTED if e not in OFFICE])
    heads = ends_of(listed.where(~settled & (F.col("length") <= max_bytes))).select("path", F.hex("head").alias("head"))
    fmt = format_of(F.col("ext"), signature_format(F.coalesce("head", F.lit(""))))
    reason = (
        F.when(F.col("length") > max_bytes, F.lit("too large"))
        .when(F.col("format").isNull(), F.lit("unsupported"))
    )
    return (
        listed.join(heads, "path", "left")
        .select("path", "length", fmt.alias("format"))
        .withColumn("reason", reason)
    )


#: Bytes that are read at either end of a file.
END_BYTES = 8


def ends_of(files: DataFrame) -> DataFrame:
    """``(path, head, tail)``: first and last bytes of the files (``path``, ``length``), read by tasks that open each and read no more.

    Tasks open local and shared folders, S3, GCS and HDFS by themselves. Of a file system that only Spark's readers know, Spark
    reads the files' contents instead; the paths of these files alone pass through the driver.
    """
    spark = files.sparkSession
    ship_package(spark)
    path = new_path(spark, "file-ends")
    files.select("path", "length").repartition("path").mapInArrow(_read_ends, "path string, head binary, tail binary, opened boolean").write.parquet(path)
    seen = spark.read.parquet(path)
    opened = seen.where("opened").drop("opened")
    others = [r["path"] for r in seen.where("NOT opened").select("path").collect()]
    if not others:
        return opened
    tail = F.substring("content", -END_BYTES, END_BYTES)
    return opened.unionByName(_files(spark, others).select("path", F.substring("content", 1, END_BYTES).alias("head"), tail.alias("tail")))


def _read_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_ends(path, length) for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.string()), *(pa.array([r and r[i] for r in rows], pa.binary()) for i in (0, 1)), pa.array([r is not None for r in rows])],
            names=["path", "head", "tail", "opened"])


def _ends(path: str, length: int) -> tuple[bytes, bytes] | None:
    """First and last bytes, or None if the file system is not known here."""
    scheme, _, rest = path.partition(":")
    try:
        if scheme == "file":
            system, place = fs.LocalFileSystem(), "/" + rest.lstrip("/")
        else:
            system, place = fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)
        with system.open_input_file(place) as file:
            return file.read_at(END_BYTES, 0), file.read_at(END_BYTES, max(length - END_BYTES, 0))
    except (pa.ArrowException, OSError, ValueError):
        return None


# The bytes at both ends of a Parquet file (the second where the footer is encrypted), and the bytes of a footer's length.
_MAGIC = (b"PAR1", b"PARE")
_FOOTER_LENGTH = 4


def broken_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(path, reason)`` of files that are no whole Parquet files, told by their ends; hidden files are not looked at."""
    files = _files(spark, path).where(~F.col("path").rlike(r"/[_.][^/]*$")).select("path", "length")
    ends = files.join(ends_of(files), "path")
    magic = [F.substring("tail", -4, 4).isin(*_MAGIC), F.substring("head", 1, 4).isin(*_MAGIC)]
    little = F.concat(*[F.substring(F.hex(F.substring("tail", 1, _FOOTER_LENGTH)), 7 - 2 * i, 2) for i in range(_FOOTER_LENGTH)])
    footer = F.conv(little, 16, 10).cast("bigint")
    reason = (
        F.when(F.col("length") < 12, F.lit("too short"))
        .when(~magic[1], F.lit("does not begin as Parquet"))
        .when(~magic[0], F.lit("cut off"))
        .when(footer + 12 > F.col("length"), F.lit("footer longer than the file"))
    )
    return ends.select("path", reason.alias("reason")).where(F.col("reason").isNotNull())


def read_parquet_files(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)``: the rows of all whole Parquet files, and ``(path, reason)`` of the others.

    Where all are whole the folder is read as it is; else the whole ones are listed for Spark. An error if none is.
    """
    where = new_path(spark, "broken-parquet")
    broken_parquet(spark, path).write.parquet(where)
    rejects = spark.read.schema("path string, reason string").parquet(where)
    if rejects.isEmpty():
        return read_parquet(spark, path), rejects
    files = _files(spark, path).where(~F.col("path").rlike(r"/[_.][^/]*$")).select("path")
    whole = [r["path"] for r in files.join(rejects, "path", "left_anti").collect()]
    if not whole:
        raise SourceError(f"no whole Parquet file in {path}")
    return read_parquet(spark, whole), rejects


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def encodings(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(path, encoding)`` of text files: UTF-8, windows-1252 or ISO-8859-1.

    Read line by line, so that large files are split. Bytes 0x80 to 0x9F are
    printable only in windows-1252.
    """
    lines = spark.read.text(paths).select(F.input_file_name().alias("path"), F.col("value"))
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    seen = lines.groupBy("path").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(latin.rlike("[\\x80-\\x9F]")).alias("c1"),
    )
    return seen.select(
        "path",
        F.when(F.col("utf8"), F.lit("UTF-8")).when(F.col("c1"), F.lit("windows-1252"))
        .otherwise(F.lit("ISO-8859-1")).alias("encoding"),
    )


# What the bytes 0x80 to 0x9F mean in windows-1252, read as ISO-8859-1 control characters.
_C1 = {chr(b): bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
_C1 = {control: sign for control, sign in _C1.items() if sign}


def _windows_signs(df: DataFrame) -> DataFrame:
    """Texts read as ISO-8859-1 that were written in windows-1252."""
    return df.select(*[
        F.translate(column(c), "".join(_C1), "".join(_C1.values())).alias(c) for c in df.columns
    ])


def read_csv_files(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)`` of CSV files of mixed encodings as one table, matched by column name."""
    groups: dict[str, list[str]] = {}
    for r in encodings(spark, paths).collect():
        groups.setdefault(r["encoding"], []).append(r["path"])
    parts = []
    for encoding, files in sorted(groups.items()):
        if encoding == "windows-1252":
            parts.append(tuple(map(_windows_signs, read_csv(spark, files, encoding="ISO-8859-1"))))
        else:
            parts.append(read_csv(spark, files, encoding=encoding))
    rows, rejects = (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), side) for side in zip(*parts))
    return rows, rejects


def load_summary(spark: SparkSession, path: str, fmt: str, df: DataFrame) -> DataFrame:
    """``(format, files, megabytes, rows, columns)`` of a table just read."""
    size = _files(spark, path).where(~F.col("path").rlike(r"/[_.][^/]*$")).agg(
        F.count("*").alias("files"), F.round(F.coalesce(F.sum("length"), F.lit(0)) / 1_048_576, 1).alias("megabytes")
    )
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    return size.select(
        F.lit(fmt).alias("format"), "files", "megabytes", rows.scalar().alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
    )
