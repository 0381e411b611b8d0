"""Nulls, empties, repeated rows, empty tables and clashing columns, in every operator and stage."""

from __future__ import annotations

import public_tokenizers
import pytest

import corpus_pipeline
from tablecare.llm import covertree, dac, minhash, packing, quality, rules, suffixes, toxicity, transducer, weighting

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, node long, root long, value string, label int, part int, rest string"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ROWS = [
    (1, "a quiet text of some words that says little", "en", "s", 5, 1, 1, 1, "v", 1, 1, "r"),
    (1, "a quiet text of some words that says little", "en", "s", 5, 1, 1, 1, "v", 1, 1, "r"),
    (2, None, None, None, None, None, None, None, None, None, None, None), (3, "", "en", None, 0, None, None, None, None, None, None, None),
    (None, "a text without an id", None, "s", 1, None, None, None, None, None, None, None), (4, LONG, "en", "s", 9, None, None, None, None, None, None, None),
    (5, LONG + " end", "en", "s", 9, None, None, None, None, None, None, None),
]
LABELS = [(1, 1, 0), (1, 1, 0), (3, 0, None), (4, 1, 1), (5, None, 0), (None, 1, 1), (77, 1, 1)]
OPERATORS = {
    "minhash": lambda d, l: minhash.near_duplicates(d),
    "tokens": lambda d, l: dac.token_rows(d, public_tokenizers.path("byte_bpe_50k.json")),
    "quality": quality.scored,
    "rules": lambda d, l: rules.judge(d),
    "weighting": lambda d, l: weighting.scored(d),
    "transducer": lambda d, l: transducer.round_trip(d, public_tokenizers.path("piece_bpe_32k.model")),
    "suffixes": lambda d, l: suffixes.without_repeats(d),
    "packing": lambda d, l: packing.pack(d, public_tokenizers.path("word_bpe_49k.json")),
    "toxicity": toxicity.scored,
}


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("rows", [ROWS, []], ids=["odd", "empty"])
def test_operator(spark, name, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = OPERATORS[name](docs, spark.createDataFrame(LABELS if rows else [], "doc_id long, quality int, toxic int")).collect()
    ids = [r["doc_id"] for r in got if name != "packing" or r["piece"] == 0]
    assert sorted(ids, key=str) == sorted((r[0] for r in rows), key=str)
    if name == "minhash" and rows:
        assert {r["doc_id"]: (r["component_id"], r["kept"]) for r in got if r["doc_id"]} == {1: (1, True), 2: (2, True), 3: (3, True), 4: (4, True), 5: (4, False)}


@pytest.mark.parametrize("rows", [[(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.1]), (2, None)], []], ids=["odd", "empty"])
def test_vectors(spark, rows):
    got = covertree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (2, 0, 2)] if rows else [], key=str)


@pytest.mark.parametrize("rows", [ROWS, []], ids=["odd", "empty"])
def test_stages(spark, rows, tmp_path):
    spark.createDataFrame(LABELS if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, SCHEMA)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")
        else:
            out.collect()


def test_pipeline_keeps_clean_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().collect()
    left = {r["doc_id"] for r in rows}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    first = {r["component_id"] for r in minhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).filter("kept").collect()}
    clean = [r["doc_id"] for r in labels if r["quality"] == 1 and not r["toxic"] and r["doc_id"] in first]
    assert sum(i in left for i in clean) >= 0.97 * len(clean)


def test_toxicity_stage_lets_toxic_documents_go(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    left = {r["doc_id"] for r in toxicity.accepted(docs, labels).select("doc_id").collect()}
    rows = labels.collect()
    dirty, clean = ([r["doc_id"] for r in rows if r["toxic"] == y] for y in (1, 0))
    assert sum(i in left for i in dirty) <= 0.1 * len(dirty) and sum(i in left for i in clean) >= 0.99 * len(clean)
