"""Context-tree weighting by plain recursion, for small texts."""

from __future__ import annotations

import collections
import math


def model(texts: list[bytes], depth: int):
    """A function that gives log10 P(next byte | the depth bytes before it) after training on ``texts``."""
    counts: dict[tuple, list[int]] = collections.defaultdict(lambda: [0, 0])
    children: dict[tuple, set] = collections.defaultdict(set)
    for text in texts:
        padded = b"\0" * depth + text + b"\0"
        for i in range(depth, len(padded)):
            for k in range(8):
                place, bit = (padded[i] + 256) >> (8 - k), padded[i] >> (7 - k) & 1
                for d in range(depth + 1):
                    counts[padded[i - d : i], place][bit] += 1
                    if d:
                        children[padded[i - d + 1 : i], place].add(padded[i - d : i])

    def kt(c):
        return math.lgamma(c[0] + 0.5) + math.lgamma(c[1] + 0.5) - math.lgamma(sum(c) + 1) - math.log(math.pi)

    cache: dict[tuple, float] = {}

    def weighted(context, place):
        if (context, place) not in cache:
            own = kt(counts[context, place])
            if len(context) < depth:
                below = sum(weighted(c, place) for c in children[context, place])
                top = max(own, below)
                own = top + math.log(math.exp(own - top) + math.exp(below - top)) - math.log(2)
            cache[context, place] = own
        return cache[context, place]

    def one(context, place, d):
        key = context[len(context) - d :], place
        if key not in counts:
            return 0.5
        c = counts[key]
        own = (c[1] + 0.5) / (sum(c) + 1)
        if d == depth:
            return own
        stop = math.exp(kt(c) - math.log(2) - weighted(*key))
        return stop * own + (1 - stop) * one(context, place, d + 1)

    def cost(context, byte):
        total = 0.0
        for k in range(8):
            p = one(context, (byte + 256) >> (8 - k), 0)
            total += math.log10(p if byte >> (7 - k) & 1 else 1 - p)
        return total

    return cost
