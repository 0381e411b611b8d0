"""The corpus pipeline: each stage works on the documents that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecare.llm import minhash, packing, quality, suffixes, toxicity
from tablecare.llm.links import stored
from tablecare.llm.text import read_table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic go."""
    return toxicity.accepted(docs, read_table(spark, sf_dir, "labels"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be of low quality go."""
    return quality.accepted(docs, read_table(spark, sf_dir, "labels"))


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the smallest id. Documents without an id all stay.

    Of documents that share an id each is judged by its own text.
    """
    rows = suffixes.keyed(docs)
    key = F.when(F.col("doc_id").isNotNull(), F.struct("__id", "__tag"))
    best = minhash.near_duplicates(rows.select(key.alias("key"), "text"), "key").filter("kept").select("key.*")
    one = rows.join(best, ["__id", "__tag"], "left_semi").select(docs.columns)
    return one.unionByName(docs.filter("doc_id is null"))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What earlier documents, or a document's own earlier bytes, say already is cut out of the texts; n_chars follows."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    cut = suffixes.without_repeats(docs, carry=others).withColumnRenamed("kept", "text")
    if "n_chars" in others:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 2048."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=60_000)  # workers live on into other stages


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality classifier", quality_stage),
    ("minhash near-dedup", minhash_stage),
    ("suffix-array dedup", suffix_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; each stage is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: SQL can't express the learned stages and the packing; tests compare them with brute force.
ORACLE_SQL = None

QUERY = {"pipeline": (run, ORACLE_SQL)}
