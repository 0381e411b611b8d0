"""Operators of this subpackage run from a folder that does not hold the package."""

from __future__ import annotations

from test_foreign_folder import run_from


def test_operators_of_each_kind(tmp_path):
    code = """
from tablecare.llm import minhash, prefixes, variants
docs = spark.createDataFrame([(1, "planted words " * 9), (2, "planted words " * 9)], "doc_id long, text string")
talks = spark.createDataFrame([(0, 0, "user", "a"), (5, 0, "user", "a")], "conv_id long, turn long, role string, text string")
print(variants.variants(docs).count(), prefixes.prefix_nodes(talks).count(), sorted(r["component_id"] for r in minhash.near_duplicates(docs).collect()))
"""
    # 18 runs of one word: at most one spelling of it is left out here and there
    words, nodes, classes = run_from(tmp_path, code).strip().split(" ", 2)
    assert int(words) in (1, 2) and int(nodes) == 2 and classes == "[1, 1]"
