"""Bounded samples of labelled rows, and their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.llm.text import crc_fold


def labelled(labels: DataFrame, column: str, folds: int, held: int) -> DataFrame:
    """(doc_id, label) of the rows to learn from: one a document, 1 if any row says so; null ids and labels don't count."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & (crc_fold("doc_id", folds) != held))
    return rows.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, by the order of a hash of the document, so the same at every run."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def with_texts(docs: DataFrame, rows: DataFrame, text: str = "text") -> DataFrame:
    """(label, text) of sampled rows; their number is bounded, so they are broadcast and the texts stay where they are."""
    return docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(rows), "doc_id").select("label", "text")
