"""Queries of the sources and sinks: what is written is read back and compared.

The files are written to a fresh path in the shared folder of the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecare.functions.dates import parse_timestamp
from queries.tables import WITH_DIRTY, dirty_orders, table
from tablecare.scratch import new_path
from tablecare.sources import (
    encodings, load_summary, manifest, read_csv, read_csv_files, read_json, read_parquet, read_parquet_files,
    write_csv, write_parquet,
)


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "orders-csv")
    write_csv(dirty_orders(spark, sf_dir), path)
    return read_csv(spark, path)[0].selectExpr(
        "CAST(o_orderkey AS BIGINT) AS o_orderkey", "CAST(amount AS DOUBLE) AS amount", "cust_txt", "priority", "status", "note"
    )


def csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a field too many are set aside, the others read."""
    path = new_path(spark, "events-csv")
    line = F.concat_ws(",", F.col("event_id").cast("string"), "event_type", F.when(F.col("user_id") % 10 == 0, F.lit("extra")))
    # one column named like the header; with tabs as separator nothing is quoted
    lines = table(spark, sf_dir, "events").select(line.alias("event_id,event_type"))
    lines.write.option("header", True).option("sep", "\t").csv(path)
    good, rejects = read_csv(spark, path)
    return good.agg(F.count("*").alias("n")).select(F.lit("good").alias("part"), "n").unionByName(
        rejects.agg(F.count("*").alias("n")).select(F.lit("rejects").alias("part"), "n"))


def csv_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, with quotes and line breaks, come back as they were."""
    path = new_path(spark, "documents-csv")
    write_csv(table(spark, sf_dir, "documents"), path)
    good, rejects = read_csv(spark, path)
    return good.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5("text").alias("text_md5"), "lang", "source").unionByName(
        rejects.select(F.lit(None).cast("bigint").alias("doc_id"), F.md5("line").alias("text_md5"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source")))


def csv_short_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders with one, two, three or four fields under a header of three."""
    path = new_path(spark, "orders-csv")
    key = F.col("o_orderkey")
    fields = [key.cast("string"), F.when(key % 4 != 1, F.col("o_orderstatus")), F.when(key % 4 > 2, F.col("o_orderpriority")), F.when(key % 7 == 0, F.lit("extra"))]
    line = F.concat_ws(",", *[f if i != 3 else F.when(key % 4 > 2, f) for i, f in enumerate(fields)])
    table(spark, sf_dir, "orders").select(line.alias("k,status,priority")).write.option("header", True).option("sep", "\t").csv(path)
    good, rejects = read_csv(spark, path)
    return good.select(F.lit("good").alias("part"), F.col("k").cast("bigint").alias("k"), "status", "priority").unionByName(
        rejects.select(F.lit("reject").alias("part"), F.split("line", ",")[0].cast("bigint").alias("k"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("priority")))


def csv_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps keep their microseconds and are read as such."""
    path = new_path(spark, "events-csv")
    write_csv(table(spark, sf_dir, "events").select("event_id", "ts"), path)
    good, _ = read_csv(spark, path)
    return good.select(F.col("event_id").cast("bigint").alias("event_id"), F.unix_micros(parse_timestamp(F.col("ts"))).alias("micros"))


def json_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "documents-json")
    docs = table(spark, sf_dir, "documents")
    docs.write.json(path)
    good, _ = read_json(spark, path, lines=True, schema="doc_id bigint, text string, lang string, source string, n_chars bigint")
    return good.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


def json_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON of events, every line of which is whole but for those of one user in ten."""
    path = new_path(spark, "events-json")
    line = F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "props": '), F.col("props"),
                    F.when(F.col("user_id") % 10 == 0, F.lit("")).otherwise(F.lit("}")))
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    good, rejects = read_json(spark, path, lines=True, schema="event_id bigint, props struct<k: bigint>")
    return good.agg(F.count("*").alias("n"), F.sum("props.k").alias("k")).select(F.lit("good").alias("part"), "n", "k").unionByName(
        rejects.agg(F.count("*").alias("n")).select(F.lit("rejects").alias("part"), "n", F.lit(None).cast("bigint").alias("k")))


def parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "lineitem-parquet")
    write_parquet(table(spark, sf_dir, "lineitem"), path)
    return read_parquet(spark, path).groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


def summary_of_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/lineitem.parquet"
    found = load_summary(spark, path, "parquet", read_parquet(spark, path))
    return found.select("format", "files", F.col("rows").alias("rows"), F.col("columns").cast("bigint").alias("columns"))


def landing_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder of the given tables as a landing folder."""
    found = manifest(spark, sf_dir)
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length", "format",
                        F.coalesce("reason", F.lit("")).alias("reason"))


def manifest_of_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions written in several formats, texts that begin like other formats, and customers above the size limit."""
    root = new_path(spark, "mixed")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name").repartition(1)
    region.write.parquet(f"{root}/a-parquet")
    region.write.option("header", True).csv(f"{root}/b-csv")
    region.write.json(f"{root}/c-json")
    for name, head in (("d-plain", ""), ("e-like-parquet", "PAR1"), ("f-like-office", "PK\x03\x04")):
        region.orderBy("r_regionkey").select(F.concat(F.lit(head), "r_name").alias("value")).coalesce(1).write.text(f"{root}/{name}")
    table(spark, sf_dir, "customer").repartition(1).write.csv(f"{root}/g-large")
    found = manifest(spark, root, max_bytes=5000).where(~F.col("path").rlike(r"/[_.][^/]*$"))
    return found.select(F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("folder"), F.coalesce("format", F.lit("")).alias("format"), F.coalesce("reason", F.lit("")).alias("reason"))


def parquet_with_broken_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in good Parquet files, and a text file that only ends like one: all rows, and the file as a reject."""
    path = new_path(spark, "orders-parquet")
    orders = table(spark, sf_dir, "orders")
    orders.repartition(3).write.parquet(path)
    orders.limit(1).select(F.lit("no Parquet, but PAR1").alias("value")).write.option("lineSep", "\x01").mode("append").text(path)
    rows, rejects = read_parquet_files(spark, path)
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 1).alias("price")).select(F.lit("rows").alias("part"), "n", "price").unionByName(
        rejects.groupBy("reason").agg(F.count("*").alias("n")).select(F.col("reason").alias("part"), "n", F.lit(None).cast("double").alias("price")))


def landing_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written in three encodings, told apart and read as one table."""
    paths = []
    # byte 0x80 is the euro sign of windows-1252
    for encoding, sign in (("UTF-8", "日本"), ("ISO-8859-1", "é"), ("ISO-8859-1", "\x80")):
        path = new_path(spark, "customers-csv")
        part = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(sign), F.col("c_mktsegment")).alias("segment"))
        part.write.option("header", True).option("encoding", encoding).csv(path)
        paths.append(path)
    files = [r["path"] for r in encodings(spark, paths).select("path").collect()]
    return read_csv_files(spark, files)[0].groupBy("segment").agg(F.count("*").alias("n"))


QUERIES = {
    "source_csv_round_trip": (csv_round_trip, f"""{WITH_DIRTY} SELECT o_orderkey, amount, cust_txt, priority,
        CASE WHEN status <> 'n/a' THEN status END AS status, note FROM dirty"""),
    "source_csv_rejects": (csv_rejects, """SELECT 'good' AS part, count(*) AS n FROM events WHERE user_id % 10 <> 0
        UNION ALL SELECT 'rejects', count(*) FROM events WHERE user_id % 10 = 0"""),
    "source_csv_documents": (csv_documents, "SELECT doc_id, md5(text) AS text_md5, lang, source FROM documents"),
    "source_csv_short_rows": (csv_short_rows, """SELECT CASE WHEN o_orderkey % 4 > 2 AND o_orderkey % 7 = 0 THEN 'reject' ELSE 'good' END AS part, o_orderkey AS k,
        CASE WHEN o_orderkey % 4 <> 1 AND NOT (o_orderkey % 4 > 2 AND o_orderkey % 7 = 0) THEN o_orderstatus END AS status,
        CASE WHEN o_orderkey % 4 > 2 AND o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority FROM orders"""),
    "source_csv_events": (csv_events, "SELECT event_id, epoch_us(ts) AS micros FROM events"),
    "source_json_lines": (json_lines_round_trip, "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"),
    "source_json_rejects": (json_rejects, """SELECT 'good' AS part, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k
        FROM events WHERE user_id % 10 <> 0 UNION ALL SELECT 'rejects', count(*), NULL FROM events WHERE user_id % 10 = 0"""),
    "source_parquet_round_trip": (parquet_round_trip, """SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS price
        FROM lineitem GROUP BY l_returnflag"""),
    "source_load_summary": (summary_of_load, """SELECT 'parquet' AS format, 1 AS files, count(*) AS "rows", 11 AS columns FROM lineitem"""),
    "source_manifest": (landing_manifest, None),
    "source_manifest_kinds": (manifest_of_kinds, """SELECT * FROM (VALUES ('a-parquet', 'parquet', ''), ('b-csv', 'csv', ''), ('c-json', 'json', ''), ('d-plain', '', 'unsupported'),
        ('e-like-parquet', 'parquet', ''), ('f-like-office', 'xlsx', ''), ('g-large', 'csv', 'too large')) t(folder, format, reason)"""),
    "source_parquet_broken": (parquet_with_broken_files, """SELECT 'rows' AS part, count(*) AS n, round(sum(o_totalprice), 1) AS price FROM orders
        UNION ALL SELECT 'does not begin as Parquet', 1, NULL"""),
    "source_encodings": (landing_encodings, """SELECT s || c_mktsegment AS segment, count(*) AS n FROM customer,
        (VALUES ('日本'), ('é'), ('€')) t(s) GROUP BY 1"""),
}
