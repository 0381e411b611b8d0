"""Line dedup and spelling variants by their definitions, for small tables."""

from __future__ import annotations

import collections
import hashlib
import re
import string
import zlib

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def line_key(line: str) -> str:
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def digests(docs: list[tuple]) -> list[tuple]:
    """(doc_id, n_lines, n_dropped, kept_sha256); an id of None counts as the smallest document."""
    order = lambda i: (i is not None, i or 0)
    held = collections.defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            if len(line_key(line)) >= 20:
                held[line_key(line)].add(order(i))
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(held[line_key(x)]) < 3 or order(i) == max(held[line_key(x)])]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


def word_counts(docs: list[tuple]) -> dict[str, int]:
    count = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            count[word] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def near(a: str, b: str) -> bool:
    """Exactly one inserted, deleted or replaced letter."""
    a, b = sorted((a, b), key=len)
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def variants(docs: list[tuple]) -> dict[str, tuple]:
    """word -> (form, root, n, n_near, form_n)"""
    n = word_counts(docs)
    found = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, others in found.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(found[w]), n.get(form[w])) for w in n}
