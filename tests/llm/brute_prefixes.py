"""The trie of rebuilt conversations by its definition, for small tables."""

from __future__ import annotations

import collections
import hashlib
import zlib


def rebuilt(rows: list[tuple]) -> dict[int, tuple]:
    """The (role, text) turns of each rebuilt conversation of (conv_id, turn, role, text) rows."""
    said = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            said[c].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [t[2:] for t in sorted(x)] for c, x in said.items()}
    out = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = (*said.get(c - c % 5, [])[:h], *own[h:])
    return out


def prefix_nodes(rows: list[tuple]) -> list[tuple]:
    convs = rebuilt(rows)
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children, leaves, saved = collections.Counter(), collections.Counter(), collections.Counter()
    for node in members:
        children[node[:-1]] += bool(node)
    for node, cs in members.items():
        own = (len(cs) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += own
            leaves[node[:d]] += not children[node]
    return sorted((min(cs), len(n), min(members[n[:-1]]) if n else None, len(cs), children[n], leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n, cs in members.items())
