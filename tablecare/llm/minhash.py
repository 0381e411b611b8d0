"""Near-duplicate texts by bottom-k sketches from one hash function.

A text's set holds its distinct word windows. Its sketch keeps the k smallest hash values of the set. Texts that keep a
common value meet in that value's inverted list; the union of two sketches estimates their similarity; the full sets
decide. Nothing is left out:

- Equal sets are one node, so groups of copies cost one row.
- Of a sketch of s values two linked texts share at least t (exact where the sketch is the whole set, else six standard
  deviations below what the threshold implies), so it is enough that each lists its s - t + 1 rarest values. What is rare
  only sets the order of values, which any order may do: the counts come from mergeable per-task counts of all sketches.
- A list's most central text is compared with all others first. Texts found linked need no further comparison with each
  other, and the pairs that remain are those of a list whose texts are not linked yet and whose sizes and places in the
  lists leave room for the shared values needed.

Null and empty texts and texts without words have an empty set and are linked with nothing. Equal rows share their node;
a null id stays null and never names a component. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.llm.links import bit_filter, components, discard, passes, stored
from tablecare.llm.text import Texts, bounded_batches, map_texts, packed, tidied, unpacked, window_hashes, span_hashes

WORDS = 5
SKETCH = 256
#: Similarity in hundredths.
SIMILAR = 75
#: Standard deviations between the threshold and what a pair must show.
SURE = 6.0
#: Values whose counts are known when lists are ordered; the others count as rare.
COMMON_VALUES = 1 << 20
#: Bits of the filters of texts that are asked for, and of values that more than one text lists.
FILTER_BITS = 1 << 23
#: Bytes of text whose words and windows a task holds at a time.
STEP = 1 << 20
VALUE_BITS = 1 << 26

_NODES = "node long, n long, sketch binary"


def distinct_windows(part: Texts, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct window hashes of each row, ascending within the row, and their number by row."""
    part = part.lower()
    starts, ends, rows = part.words()
    hashes = span_hashes(part.data, starts, ends)
    windows, _, n = window_hashes(hashes, np.bincount(rows, minlength=len(part)), size)
    row = np.repeat(np.arange(len(part)), n)
    order = np.lexsort((windows, row))
    windows, row = windows[order], row[order]
    first = np.ones(len(windows), bool)
    first[1:] = (windows[1:] != windows[:-1]) | (row[1:] != row[:-1])
    return windows[first], np.bincount(row[first], minlength=len(part))


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each row's values, modulo 2^64."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def heads(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first ``most`` values of each row, and their number."""
    kept = np.minimum(counts, most)
    firsts = np.cumsum(counts) - counts
    return np.repeat(firsts - (np.cumsum(kept) - kept), kept) + np.arange(kept.sum()), kept


def sketches(docs: DataFrame, text: str, carry: list[str], size: int = WORDS, k: int = SKETCH) -> DataFrame:
    """``carry``, node (a fingerprint of the set, null if empty), n (set size) and sketch (32-bit values, ascending) per row."""
    from tablecare.llm.text import mix

    fields = [docs.schema[c] for c in carry]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def work(part: Texts) -> pa.RecordBatch:
        values, n = distinct_windows(part, size)
        at, kept = heads(n, k)
        node = mix(sums(mix(values ^ np.uint64(0x5851F42D4C957F2D)), n) + n.astype(np.uint64)).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [*(part.rows.column(i) for i in range(len(carry))), pa.array(node, mask=n == 0), pa.array(n.astype(np.int64)),
             packed((values[at] >> np.uint64(32)).astype(np.uint32), kept)], names=[*carry, "node", "n", "sketch"])

    return map_texts(docs.select(*carry, F.col(text).alias("__text")), work, f"{schema}, {_NODES}", "__text", STEP)


def shared_least(n: np.ndarray, k: int, similar: int) -> np.ndarray:
    """How many values of its sketch a text of ``n`` windows shares with any linked text's sketch at least."""
    j = similar / 100
    exact = np.ceil(n * similar / 100)
    union = np.maximum(np.floor(n / j), k + 1)
    spread = np.sqrt(k * j * (1 - j) * (union - k) / (union - 1))
    return np.maximum(1, np.where(n / j <= k, exact, np.minimum(exact, np.floor(j * k - SURE * spread)))).astype(np.int64)


def _common(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Values that many sketches hold, with counts: each task counts its own and hands on those it has twice."""
    def count(batches):
        for batch in batches:
            values, n = np.unique(unpacked(batch.column(0), np.uint32)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values[n > 1].astype(np.int64)), pa.array(n[n > 1])], names=["value", "seen"])

    counted = nodes.select("sketch").mapInArrow(tidied(count), "value long, seen long").groupBy("value").agg(F.sum("seen").alias("seen"))
    rows = counted.orderBy(F.desc("seen"), "value").limit(COMMON_VALUES).toArrow()
    values, seen = rows.column("value").to_numpy(), rows.column("seen").to_numpy()
    order = np.argsort(values)
    return values[order].astype(np.uint32), seen[order]


def _listed(nodes: DataFrame, k: int, similar: int) -> DataFrame:
    """The inverted lists' entries: value, node, n, room (values of the sketch from this one on), least (see shared_least)."""
    spark = nodes.sparkSession
    common = spark.sparkContext.broadcast(_common(nodes))

    def entries(batches, shared=None):
        values_known, seen_known = common.value
        for batch in batches:
            values, s = unpacked(batch.column(2), np.uint32)
            n = batch.column(1).to_numpy()
            row = np.repeat(np.arange(len(s)), s)
            seen = np.ones(len(values), np.int64)
            if len(values_known):
                at = np.minimum(np.searchsorted(values_known, values), len(values_known) - 1)
                seen = np.where(values_known[at] == values, seen_known[at], 1)
            order = np.lexsort((values, seen, row))
            least = np.minimum(shared_least(n, k, similar), s)
            place = np.arange(len(values)) - np.repeat(np.cumsum(s) - s, s)
            use = place <= np.repeat(s - least, s)
            if shared is None:
                yield pa.RecordBatch.from_arrays([pa.array(values[order][use].astype(np.int64))], names=["value"])
                continue
            use &= passes(shared.value, values[order].astype(np.int64))
            row = row[use]
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[order][use].astype(np.int64)), batch.column(0).take(pa.array(row)), pa.array(n[row]),
                 pa.array((s[row] - place[use]).astype(np.int32)), pa.array(least[row].astype(np.int32))],
                names=["value", "node", "n", "room", "least"])

    rows = nodes.select("node", "n", "sketch")
    counted = rows.mapInArrow(tidied(entries), "value long").groupBy("value").agg(F.count("*").alias("many")).filter("many > 1")
    shared = spark.sparkContext.broadcast(bit_filter(counted.select("value"), VALUE_BITS))
    return rows.mapInArrow(tidied(lambda batches: entries(batches, shared)), "value long, node long, n long, room int, least int")


def _possible(a: str, b: str, k: int, similar: int) -> F.Column:
    """Sizes and places leave room for a link."""
    an, bn = F.col(f"{a}.n"), F.col(f"{b}.n")
    more = F.greatest(an, bn)
    common = (an + bn) * similar / (100.0 + similar)  # of the full sets, at least
    # of the k values that the larger set's sketch holds, so many are common but for chance
    q = F.least(common / more, F.lit(1.0))
    spread = F.sqrt(k * q * (1 - q) * F.greatest(more - k, F.lit(0)) / F.greatest(more - 1, F.lit(1)))
    needed = F.when(more <= k, F.ceil(common)).otherwise(
        F.least(F.ceil(common), F.floor(k * q - SURE * spread) - 1)).cast("long")
    needed = F.greatest(needed, F.greatest(f"{a}.least", f"{b}.least").cast("long"))
    return (an * 100 >= bn * similar) & (bn * 100 >= an * similar) & (F.least(f"{a}.room", f"{b}.room") >= needed)


def _nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select("a").unionByName(pairs.select(F.col("b").alias("a")))


def _estimated(pairs: DataFrame, nodes: DataFrame, k: int, similar: int) -> DataFrame:
    """The pairs (a, b) that the union of the two sketches doesn't rule out."""
    def judge(batches):
        for batch in batches:
            keep = []
            for i, (x, y, m, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4, 5)))):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = np.sort(np.concatenate([x, y]))
                twice = np.flatnonzero(both[1:] == both[:-1])
                union = len(both) - len(twice)
                if m <= k and n <= k:
                    keep.append(100 * len(twice) >= similar * union - 100)
                    continue
                of = min(k, union)  # the k smallest of the union, and how many of them both keep
                upto = both[np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))[of - 1]]
                common = np.count_nonzero(both[twice] <= upto)
                j = similar / 100
                keep.append(common >= j * of - SURE * math.sqrt(of * j * (1 - j)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    needed = nodes.sparkSession.sparkContext.broadcast(bit_filter(_nodes_of(pairs), FILTER_BITS))

    def asked(batches):
        for batch in batches:
            yield batch.filter(pa.array(passes(needed.value, batch.column(0).to_numpy())))

    few = nodes.select("node", "n", "sketch").mapInArrow(tidied(asked), "node long, n long, sketch binary")
    one = few.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("sketch").alias("x"))
    other = few.select(F.col("node").alias("b"), "n", F.col("sketch").alias("y"))
    both = pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y", "m", "n")
    return both.mapInArrow(tidied(judge), "a long, b long")


def _sets_of(pairs: DataFrame, docs: DataFrame, text: str, size: int) -> DataFrame:
    """(node, set) of the texts in ``pairs``: a filter of fixed size tells tasks which texts they need, so texts are not shuffled."""
    needed = docs.sparkSession.sparkContext.broadcast(bit_filter(_nodes_of(pairs), FILTER_BITS))

    def work(part: Texts) -> pa.RecordBatch:
        from tablecare.llm.text import mix

        values, n = distinct_windows(part, size)
        node = mix(sums(mix(values ^ np.uint64(0x5851F42D4C957F2D)), n) + n.astype(np.uint64)).astype(np.int64)
        use = (n > 0) & passes(needed.value, node)
        return pa.RecordBatch.from_arrays([pa.array(node[use]), packed(values[np.repeat(use, n)], n[use])], names=["node", "full"])

    found = map_texts(docs.select(F.col(text).alias("__text")), work, "node long, full binary", "__text", STEP)
    # equal sets come from every copy: one row a task and node is shuffled
    return found.groupBy("node").agg(F.first("full").alias("full"))


def _verified(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    def judge(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= similar * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("node").alias("b"), F.col("full").alias("y"))
    other = sets.select(F.col("node").alias("a"), F.col("full").alias("x"))
    return pairs.join(one, "b").join(other, "a").select("a", "b", "x", "y").mapInArrow(tidied(judge), "a long, b long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = WORDS, k: int = SKETCH, similar: int = SIMILAR) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row of ``docs``: similar texts, and what is reachable over them, share the smallest id."""
    bounded_batches(docs.sparkSession)
    rows = stored(sketches(docs, text, [id_column], size, k), "sketches")
    full = rows.filter("node is not null")
    nodes = stored(full.groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "nodes")
    # sketches are needed once a node from here on
    slim = stored(rows.drop("sketch"), "rows")
    discard(rows)
    rows, full = slim, slim.filter("node is not null")
    lists = stored(_listed(nodes, k, similar), "lists")

    heads_of = lists.groupBy("value").agg(
        F.count("*").alias("many"), F.max(F.struct("room", "node", "n", "least")).alias("head")).filter("many > 1").select("value", "head.*")
    first = lists.alias("x").join(heads_of.alias("h"), "value").filter(
        (F.col("x.node") != F.col("h.node")) & _possible("x", "h", k, similar)
    ).select(F.col("h.node").alias("a"), F.col("x.node").alias("b")).distinct()
    near = stored(first, "near")
    first = stored(_estimated(near, nodes, k, similar), "pairs")
    discard(near)
    sets = stored(_sets_of(first, docs, text, size), "sets")
    linked = stored(_verified(first, sets, similar), "linked")
    discard(sets)

    # texts already linked to one head, or to heads that are linked, need no comparison with each other
    label = stored(components(linked), "labels")
    open_lists = lists.join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_lists = stored(open_lists, "open")
    discard(lists)
    mixed = open_lists.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("value")
    own = open_lists.join(mixed, "value").groupBy("node", "n", "root", "least").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("room")).alias("at"), "value"))).alias("own"))
    left = own.select("node", "n", "root", "least", F.posexplode("own").alias("place", "it"), F.expr("transform(own, x -> x.value)").alias("values")).select(
        "node", "n", "root", "least", F.col("it.value").alias("value"), (-F.col("it.at")).alias("room"), F.expr("slice(values, 1, place)").alias("before"))
    left = stored(left, "left")
    discard(open_lists)
    rest = left.alias("x").join(left.alias("y"), "value").filter(
        (F.col("x.root") != F.col("y.root")) & (F.struct("x.n", "x.node") < F.struct("y.n", "y.node")) & _possible("x", "y", k, similar)
        & ~F.arrays_overlap("x.before", "y.before")  # each pair at its first common value only
    ).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    done = first.unionByName(first.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = stored(rest.join(done, ["a", "b"], "left_anti"), "near")
    discard(left)
    rest = stored(_estimated(near, nodes, k, similar), "pairs")
    discard(near, nodes)
    if rest.head(1):
        sets = stored(_sets_of(rest, docs, text, size), "sets")
        label = components(linked.unionByName(_verified(rest, sets, similar)))
        discard(sets)

    ids = full.groupBy("node").agg(F.min(id_column).alias("low")).join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))
    low = ids.groupBy("root").agg(F.min("low").alias("component_id"))
    named = ids.join(low, "root").select("node", "component_id")
    out = rows.join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col(id_column)).otherwise(F.col("component_id"))
    return out.select(id_column, F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col(id_column) == component, F.lit(False)).alias("kept"))
