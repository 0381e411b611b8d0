"""A block's list of costs is put in order without a pile of copies of its keys."""

from __future__ import annotations

import tracemalloc

import numpy as np

from tablecare.llm.weighting import Lookup


def test_keys_are_put_in_order_in_little_memory():
    rng = np.random.default_rng(7)
    keys = np.unique(rng.integers(0, 1 << 56, 1_500_000, dtype=np.uint64))
    values = np.arange(len(keys), dtype=np.float32)
    lists = [(keys[i::7].copy(), values[i::7].copy()) for i in range(7)]
    asked = rng.integers(0, len(keys), 10_000)
    wanted, some = values[asked], keys[asked]
    size = keys.nbytes
    del keys, values
    tracemalloc.start()
    found = Lookup(lists)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3.7 * size
    assert (found(some) == wanted).all()
