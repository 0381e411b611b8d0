"""Filters of ids that grow with the ids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tablecare.llm import suffixes


def test_filters_of_many_first_occurrences_let_few_others_pass(spark):
    firsts = spark.range(4_000_000).select(F.xxhash64("id").alias("name"), (F.col("id") % 1000).alias("id"), F.lit(-1).cast("long").alias("tag"), F.col("id").alias("start"))
    marks, texts = (found.value for found in suffixes._filters(firsts))
    for found in (marks, texts):
        assert np.unpackbits(found.view(np.uint8)).mean() < 0.12
    assert suffixes.passes(texts, np.arange(1000)).all()
