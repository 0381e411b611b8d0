"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re

import numpy as np

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def lower(text: str | None) -> bytes:
    return re.sub(b"[A-Z]", lambda m: m[0].lower(), (text or "").encode())


def shingles(text: str | None) -> frozenset:
    words = WORD.findall(lower(text))
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def classes(names: list, linked) -> dict:
    """The smallest name reachable from each, by ``linked(i, j)``."""
    up = {n: n for n in names}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for i, a in enumerate(names):
        for b in names[:i]:
            if linked(a, b):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {n: root(n) for n in names}


def near_duplicates(docs: list[tuple]) -> dict:
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    found = classes(ids, lambda a, b: bool(sets[a]) and bool(sets[b]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    return {i: (len(sets[i]), found[i], found[i] == i) for i in ids}


def without_repeats(docs: list[tuple], size: int = 100) -> dict:
    seen, out = set(), {}
    for i, text in sorted(docs):
        raw = (text or "").encode()
        covered = np.zeros(len(raw) + 1, int)
        for p in range(len(raw) - size + 1):
            if raw[p : p + size] in seen:
                covered[p] += 1
                covered[p + size] -= 1
            seen.add(raw[p : p + size])
        gone = np.cumsum(covered)[:-1] > 0
        left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())
    return out


def segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """Maximal scoring segments by their definition: the best one, then those of what is left on either side."""
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            # of equals the shortest: no part of a maximal segment scores as much as the whole
            if total > 0 and (best is None or (total, i - j) > (best[0], best[1] - best[2])):
                best = (total, i, j)
    if best is None:
        return []
    _, i, j = best
    right = [(s, a + j + 1, b + j + 1) for s, a, b in segments(scores[j + 1 :])]
    return [*segments(scores[:i]), best, *right]
