"""The queries of the operators of this subpackage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tablecare.llm import covertree, dac, linebits, minhash, packing, prefixes, quality, rules, suffixes, toxicity, transducer, variants, weighting
from tablecare.llm.text import read_table


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.token_rows(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(read_table(spark, sf_dir, "documents"))


def op6_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighting.scored(read_table(spark, sf_dir, "documents"))


def op7_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(read_table(spark, sf_dir, "documents"), digest_only=True).drop("kept")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linebits.digests(read_table(spark, sf_dir, "documents"))


def op12_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(read_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_nodes(read_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_minhash": (op1_minhash, None),
    "op2_cover_tree": (op2_cover_tree, None),
    "op3_token_files": (op3_token_files, None),
    "op4_quality": (op4_quality, None),
    "op5_rules": (op5_rules, None),
    "op6_context_tree": (op6_context_tree, None),
    "op7_transducer": (op7_transducer, None),
    "op8_suffixes": (op8_suffixes, None),
    "op9_packing": (op9_packing, None),
    "op10_toxicity": (op10_toxicity, None),
    "op11_line_bitmaps": (op11_line_bitmaps, linebits.ORACLE_SQL),
    "op12_partenum": (op12_partenum, None),
    "op13_prefix_trie": (op13_prefix_trie, None),
}
