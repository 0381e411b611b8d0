"""Rows that share an id, or have none, are documents of their own."""

from __future__ import annotations

import collections
import hashlib
import random

import brute

import corpus_pipeline
from tablecare.llm import suffixes


def long_text(seed: int) -> str:
    return "".join(random.Random(seed).choices("abcdefgh ", k=400))


def test_rows_that_share_an_id_are_cut_by_their_own_texts(spark):
    a, b, c = (long_text(i) for i in range(3))
    rows = [(None, a + c), (None, b), (None, "x" + a), (1, b + c), (1, c), (1, c), (2, a[:150] + "y" * 90), (3, long_text(9)), (4, None), (None, None)]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest() if t is not None else ""
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1])))
    want = brute.without_repeats([(k, t) for k, (_, t) in enumerate(ordered)])
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    got = suffixes.without_repeats(df).collect()
    columns = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert collections.Counter((r["doc_id"], *(r[c] for c in columns)) for r in got) == collections.Counter((ordered[k][0], *want[k]) for k in want)


def test_minhash_stage_keeps_other_texts_of_an_id(spark):
    rows = [(5, "the first text of this id tells one story"), (5, "another text under the same id tells more of it"), (5, "the first text of this id tells one story"),
            (6, "another text under the same id tells more of it"), (None, "no id"), (None, "no id")]
    got = corpus_pipeline.minhash_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([*rows[:2], *rows[4:]], key=str)
