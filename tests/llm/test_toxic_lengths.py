"""Toxic texts of other lengths than clean ones, and the model's numbers against their definitions."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from tablecare.llm import toxicity

WORDS = [a + b + c for a in ("ba", "ne", "ti", "so") for b in ("la", "mi", "ru", "k", "") for c in ("n", "ste", "or", "w", "zu")]
BAD = ["scoundrel", "wretch", "vermin", "lout"]


def made(longer: float, n: int = 900) -> tuple[list[tuple], list[tuple]]:
    """Documents of one vocabulary; one in five has two to four bad words and ``longer`` times the length. Most are labelled."""
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 2
        words = rng.choices(WORDS, weights=[1 / (k + 1) for k in range(len(WORDS))], k=int(rng.randrange(20, 120) * (longer if toxic else 1)))
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "s"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


@pytest.mark.parametrize("longer", [0.5, 1.0, 1.5, 4.0])
def test_length_is_no_sign_of_toxicity(spark, longer):
    docs, labels = made(longer)
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.a >= 0 and model.lam > 0.01 and len(model.keys) < 100
    truth = dict(labels)
    rows = toxicity.scored(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] for r in held if truth[r["doc_id"]]) >= 0.9 * sum(truth[r["doc_id"]] for r in held)
    assert sum(not r["predicted"] for r in held if not truth[r["doc_id"]]) >= 0.95 * sum(not truth[r["doc_id"]] for r in held)


def test_lexicon_by_its_definition(spark):
    docs, labels = made(1.5, 300)
    truth = dict(labels)
    sample = spark.createDataFrame([(truth[i], t) for i, t in docs], "label int, text string").repartition(3)
    keys, odds = toxicity._lexicon(sample)
    count: dict[str, list[int]] = {}
    total = [0, 0]
    for i, text in docs:
        whole = set(text.split())
        total[truth[i]] += len(whole)
        for f in whole | {f"{w[:k]}*" for w in whole for k in range(3, 9) if k < len(w)}:
            count.setdefault(f, [0, 0])[truth[i]] += 1
    want = []
    for zeros, ones in count.values():
        if ones <= 2:
            continue
        prior = toxicity.PRIOR * (ones + zeros) / sum(total)
        y, x = ones + prior, zeros + prior
        odd = math.log(y / (total[1] + toxicity.PRIOR - y)) - math.log(x / (total[0] + toxicity.PRIOR - x))
        expected = [(ones + zeros) * t / sum(total) for t in total]
        ratio = 2 * sum(n * math.log(n / e) for n, e in ((zeros, expected[0]), (ones, expected[1])) if n)
        if odd > toxicity.EFFECT and ratio > toxicity.SURE**2:
            want.append(odd)
    assert len(keys) == len(want) > 0 and np.allclose(sorted(odds), sorted(want))


def test_lambda_solves_its_equation():
    clean = np.array([[0.5, 2.0, 4.0], [30, 10, 2]])
    miss = toxicity._miss(0.05, 0.02, clean, 1000)
    assert miss * (1 - 0.042) + (clean[0] * clean[1]).sum() / 1000 < 0  # the mean score of clean text is below zero
    lam = toxicity._lambda(clean, 1000, miss, np.array([2.0]))
    total = (clean[1] * np.exp(lam * clean[0])).sum() / 1000 + np.exp(lam * 2.0) / 1000 + (1 - 43 / 1000) * np.exp(lam * miss)
    assert total == pytest.approx(1) and lam > 0


def test_the_slope_never_falls():
    x = np.linspace(0, 5, 50)
    a, b = toxicity._logistic(x, (x < 2).astype(float), np.ones(50))
    assert a == 0 and 1 / (1 + math.exp(-b)) == pytest.approx(0.4, abs=0.05)
    a, _ = toxicity._logistic(x, (x > 2).astype(float), np.ones(50))
    assert a > 0


def test_words_that_clean_text_never_has_are_in_the_lexicon(spark):
    docs, labels = made(1.0, 300)
    truth = dict(labels)
    docs = [(i, t + " neverclean" if truth[i] else t) for i, t in docs]
    keys, odds = toxicity._lexicon(spark.createDataFrame([(truth[i], t) for i, t in docs], "label int, text string"))
    seen = Counter(w for i, t in docs if truth[i] for w in set(t.split()))
    assert seen["neverclean"] == 60 and max(odds) > 4
