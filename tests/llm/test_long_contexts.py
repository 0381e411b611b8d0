"""Contexts longer than a few bytes tell something."""

from __future__ import annotations

import random

from tablecare.llm import weighting


def test_what_follows_five_bytes_is_learned(spark):
    rng = random.Random(3)
    # the byte after "bbbbb" follows from the byte before: five bytes say nothing, six tell it
    texts = ["".join(c + "bbbbb" + {"x": "1", "y": "2"}[c] for c in rng.choices("xy", k=40)) for _ in range(120)]
    rows = weighting.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).filter("held_out").collect()
    # one bit for each of the 40 letters x and y is needed; short contexts need a second one for each digit
    assert rows and all(-r["score"] / 0.30103 < 1.5 * 40 for r in rows)
