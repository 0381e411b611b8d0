"""A block's list of costs takes over what it is made of."""

from __future__ import annotations

import numpy as np

from tablecare.llm.weighting import Lookup


def test_lists_are_taken_over():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 56, 20_000, dtype=np.uint64))
    values = np.arange(len(keys), dtype=np.float32)
    lists = [(keys[i::7], values[i::7]) for i in range(7)]
    found = Lookup(lists)
    assert lists == []  # nothing holds the parts while keys are put in order
    asked = rng.permutation(len(keys))
    assert (found(keys[asked]) == values[asked]).all()
