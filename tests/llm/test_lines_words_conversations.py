"""Line dedup, spelling variants and the trie of conversations against brute force; nulls, ties, empties, clashing names."""

from __future__ import annotations

import random
import zlib

import brute_lines
import brute_prefixes
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tablecare.llm import linebits, prefixes, variants

CLASH = "doc_id long, text string, id long, tag string, pos string, k1 long, bits string, word string, n string, line string"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def with_clashes(spark, docs, parts=3):
    return spark.createDataFrame([(*d, 7, "t", "p", 1, "b", "w", "n", "l") for d in docs], CLASH).repartition(parts)


def lined(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    pool = [f"a line that {k} documents may share" for k in range(12)] + ["Ünïcode LINE of length é " * 2, "\tPadded line of some length \r", "short", "", "É" * 20, "x" * 19, "y" * 20]
    docs = []
    for i in range(n):
        lines = [rng.choice(pool) if rng.random() < 0.7 else f"line {i} {rng.random()} of its own" for _ in range(rng.choice([0, 1, 3, 8, 150]))]
        lines = [x.upper() if rng.random() < 0.1 and x.isascii() else x for x in lines]
        docs.append((i if rng.random() < 0.9 else None, rng.choice([None, "", "\n"]) if not lines else "\n".join(lines)))
    return docs + docs[:5] + [(3, "another text of one id\n" + pool[0]), (n + 5, pool[1] * 3000)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("hot", [1024, 8])
def test_lines(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(linebits, "HOT", hot)
    docs = lined(60, seed)
    got = linebits.digests(with_clashes(spark, docs))
    assert sorted(map(tuple, got.collect()), key=str) == brute_lines.digests(docs)


def test_lines_at_the_limits(spark):
    line, twenty = "the very same line again", "É" * 20
    docs = [(1, f"{line}\n{line}"), (2, f" {line.upper()}\t\n{twenty}"), (3, f"{line}\n{line}\n{twenty}"), (4, "É" * 19), (5, "É" * 19), (6, "É" * 19), (7, twenty.lower())]
    got = {r["doc_id"]: r["n_dropped"] for r in linebits.digests(with_clashes(spark, docs)).collect()}
    # two documents are too few for the line of É; the largest document keeps both its lines
    assert got == {1: 2, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0}
    assert linebits.digests(with_clashes(spark, [])).collect() == []


def test_a_line_in_most_documents_is_counted_apart(spark):
    docs = [(i, f"own line number {i} is here\nthe line of everybody here" + "\nown again" * (i % 3)) for i in range(600)]
    df = with_clashes(spark, docs, 8)
    lines = linebits.keyed_lines(df)
    assert linebits._frequent(lines).collect() == lines.filter(F.col("pos") == 1).select("k1").distinct().collect()
    assert sorted(map(tuple, linebits.digests(df).collect()), key=str) == brute_lines.digests(docs)


def test_lines_in_duckdb(sf_dir, spark):
    got = sorted(map(tuple, linebits.digests(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
        assert got == sorted(db.execute(linebits.ORACLE_SQL).fetchall())


def test_main_path_of_lines_is_native(spark):
    plan = linebits.digests(with_clashes(spark, lined(10, 1)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowEvalPython", "Arrow")


def worded(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    base = ["variant", "spelling", "Überholung", "aaaaaaaa", "abababab", "letters", "éàüöéàü", "conversation"]
    docs = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(0, 60)):
            w = rng.choice(base)
            for _ in range(rng.choice([0, 0, 0, 0, 0, 1, 2])):
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abé") + w[k:], w[:k] + rng.choice("abé") + w[k + 1 :]]) or w
            words.append(w)
        docs.append((i if rng.random() < 0.95 else None, rng.choice([" ", ", ", "1"]).join(words) if words else rng.choice([None, ""])))
    return docs + docs[:4] + [(n + 1, "variant " * 20_000)] + [(n + 10 + i, "planted " * 100 + "plantedx " * 3 + "plantedxy " * (i == 3) * 2) for i in range(10)]


@pytest.mark.parametrize("group", [128, 3, 1])
def test_variants(spark, group):
    docs = worded(150, 4)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in variants.variants(with_clashes(spark, docs), group=group).collect()}
    want = brute_lines.variants(docs)
    assert got == want
    assert any(form and form != root for form, root, *_ in want.values())  # a chain of forms
    assert variants.variants(with_clashes(spark, [])).collect() == []


def test_crc_of_many_spans():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 500).astype(np.uint8)
    starts = rng.integers(0, 400, 50)
    ends = starts + rng.integers(0, 60, 50)
    before = rng.integers(0, 1 << 32, 50).astype(np.uint32)
    assert variants._crc(data, starts, ends, before).tolist() == [zlib.crc32(data[a:b].tobytes(), int(x)) for a, b, x in zip(starts, ends, before)]


def test_words_one_letter_apart_share_a_signature():
    rng = random.Random(3)
    for _ in range(3000):
        w = "".join(rng.choice("abcdé") for _ in range(rng.randrange(7, 14)))
        k = rng.randrange(len(w) + 1)
        x = rng.choice([w[:k] + rng.choice("abz") + w[k:], w[: max(k - 1, 0)] + w[k:], w[: max(k - 1, 0)] + "q" + w[max(k, 1) :]])
        assert not brute_lines.near(w, x) or set(variants.signatures(w)) & set(variants.signatures(x)), (w, x)


def talks(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for c in range(-5, 120):
        if rng.random() < 0.2:
            continue
        for t in range(rng.choice([0, 1, 3, 9, 14, 40])):
            rows.append((c if rng.random() < 0.98 else None, t if t or rng.random() < 0.5 else None, "user" if t < 13 else rng.choice(["user", "assistant", None]),
                         f"t{t}" if t % 7 != 6 else rng.choice(["é", "", None, "bb"]), "x", 1))
    return rows


TALK = "conv_id long, turn long, role string, text string, c string, d long"


@pytest.mark.parametrize("unit, rows, ids", [(10, 100_000, 12), (2, 50, 3), (1, 7, 0)])
def test_prefix_nodes(spark, monkeypatch, unit, rows, ids):
    for name, value in (("UNIT_BITS", unit), ("SHARD_ROWS", rows), ("_IDS_BITS", ids)):
        monkeypatch.setattr(prefixes, name, value)
    said = talks(1)
    said += [(c, 50, "user", "again", "x", 1) for c in (1, 1, 2, 2)]  # repeated rows
    got = prefixes.prefix_nodes(spark.createDataFrame(said, TALK).repartition(5)).select(*NODE)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_prefixes.prefix_nodes([r[:4] for r in said]), key=str)
    assert prefixes.prefix_nodes(spark.createDataFrame([], TALK)).collect() == []


def test_copies_of_a_conversation_and_one_long_one(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "UNIT_BITS", 5)
    said = [(c, t, "user", f"text {t}", "x", 1) for c in range(150) for t in range(3)] + [(1000, t, "user", f"text {t % 50}", "x", 1) for t in range(200)]
    got = prefixes.prefix_nodes(spark.createDataFrame(said, TALK).repartition(5)).select(*NODE)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_prefixes.prefix_nodes([r[:4] for r in said]), key=str)


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 5000):
        keys = rng.integers(0, 1 << 63, (n, 2)).astype(np.uint64)
        slots = prefixes.Slots(keys)
        assert sorted(slots.find(keys).tolist()) == list(range(n))
        assert (slots.find(rng.integers(0, 1 << 63, (100, 2)).astype(np.uint64)) == -1).all()
