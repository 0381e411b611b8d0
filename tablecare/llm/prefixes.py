"""The trie of conversations' beginnings, in tables addressed by a minimal perfect hash.

A turn counts by its role and text. The first d turns of a conversation have a 128-bit digest, the exclusive or of their turns' hashes
with their places, so that a long conversation's digests are found piece by piece. Conversations are dealt to shards by a hash of
their id, so a beginning that a third of them share is spread over all shards; a conversation is cut every UNIT turns and each
unit is dealt for itself. A shard's distinct digests get slots by a minimal perfect hash (levels of bits; what collides goes to the next),
and every look-up is verified against the digest in the slot. Counts are scattered into flat arrays and added up from child slot to
parent slot, the deepest first. Sums of shards add up, as each node is owned by one shard, that of its smallest member; what
lies in later units of a conversation is carried to the last node of the unit before. Two beginnings of one digest end the job.

Rows without conv_id belong to no conversation and are left out. Null roles and texts are empty. Turns of equal number (null first) come in
the order of a digest of role and text; repeated rows are turns of their own. Very long texts leave their hash and length only. An
empty table has no node. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecare.llm.links import discard, stored
from tablecare.llm.text import bounded_batches, mix

#: Turns of one conversation that are worked on together; a power of two.
UNIT_BITS = 10
#: Rows of a shard, on average.
SHARD_ROWS = 100_000
#: Conversations are rebuilt from the first of GROUP neighbours, of which up to MOST - 1 turns are taken.
GROUP, MOST = 5, 9
_IDS_BITS = 12


def _placed(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, p, t1, t2, bytes): turns with their place from 0; and (c, n_own) of every conversation."""
    said = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), F.xxhash64(F.lit(1), *said).alias("t1"),
        F.xxhash64(F.lit(2), *said).alias("t2"), F.octet_length(said[1]).cast("long").alias("bytes"))
    # turns are numbered within ranges of their numbers, and what comes before a range is counted
    turns = turns.withColumn("part", F.coalesce(F.shiftright("turn", UNIT_BITS), F.lit(-(1 << 62))))
    counts = turns.groupBy("c", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("c", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("c", "part").orderBy(F.asc_nulls_first("turn"), "t1", "t2"))
    rows = turns.withColumn("nth", nth).join(before, ["c", "part"]).select("c", (F.col("nth") - 1 + F.col("before")).alias("p"), "t1", "t2", "bytes")
    return stored(rows, "turns"), counts.groupBy("c").agg(F.sum("n").alias("n_own"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, d, t1, t2, bytes): turn d, from 1, of each rebuilt conversation; and (c, n_turns) of every conversation.

    Conversation c begins with the first h turns of conversation c - c % GROUP, h = crc32 of its decimal id % MOST; its own turns
    after its first h follow.
    """
    placed, own = _placed(conversations)
    heads = placed.filter((F.col("p") < MOST - 1) & (F.pmod("c", F.lit(GROUP)) == 0)).groupBy("c").agg(
        F.sort_array(F.collect_list(F.struct("p", "t1", "t2", "bytes"))).alias("head")).withColumnRenamed("c", "base")
    convs = own.select("c", "n_own", (F.crc32(F.col("c").cast("string").cast("binary")) % MOST).alias("h"), (F.col("c") - F.pmod("c", F.lit(GROUP))).alias("base"))
    convs = convs.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("h").cast("int")))
    convs = stored(convs.select("c", "n_own", "h", "head", F.size("head").cast("long").alias("n_base")), "conversations")
    first = convs.select("c", F.explode("head").alias("e")).select("c", (F.col("e.p") + 1).alias("d"), "e.t1", "e.t2", "e.bytes")
    # a long conversation's rows meet copies of its one row here
    spread = convs.select("c", "h", "n_base", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright("n_own", UNIT_BITS))).alias("part"))
    later = placed.withColumn("part", F.shiftright("p", UNIT_BITS)).join(spread, ["c", "part"]).filter("p >= h").select(
        "c", (F.col("n_base") + F.col("p") - F.col("h") + 1).alias("d"), "t1", "t2", "bytes")
    rows = stored(first.unionByName(later), "rebuilt")
    lengths = stored(convs.select("c", (F.col("n_base") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n_turns")), "lengths")
    discard(placed, convs)
    return rows, lengths


def _prefixes(rows: DataFrame) -> DataFrame:
    """(c, d, unit, g1, g2, p1, p2, bytes): digests of the beginning that ends with each turn, and of that without it."""
    rows = rows.select("c", "d", F.shiftright(F.col("d") - 1, UNIT_BITS).alias("unit"), "bytes",
                       *(F.xxhash64(F.lit(i), "d", "t1", "t2").alias(f"e{i}") for i in (1, 2)))
    units = rows.groupBy("c", "unit").agg(F.bit_xor("e1").alias("x1"), F.bit_xor("e2").alias("x2"))
    earlier = Window.partitionBy("c").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    before = units.select("c", "unit", *(F.coalesce(F.bit_xor(f"x{i}").over(earlier), F.lit(0)).alias(f"x{i}") for i in (1, 2)))
    upto = Window.partitionBy("c", "unit").orderBy("d")
    running = rows.select("c", "d", "unit", "bytes", "e1", "e2", *(F.bit_xor(f"e{i}").over(upto).alias(f"r{i}") for i in (1, 2))).join(before, ["c", "unit"])
    whole = running.select("*", *(F.col(f"r{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"g{i}") for i in (1, 2)))
    return whole.select("c", "d", "unit", "g1", "g2", *(F.col(f"g{i}").bitwiseXOR(F.col(f"e{i}")).alias(f"p{i}") for i in (1, 2)), "bytes")


class Slots:
    """A minimal perfect hash of distinct 128-bit keys (two columns of 64 bits): each has a slot below their number.

    Level by level the keys are hashed into twice as many places as are left; those alone in their place stay there, and the
    rank of the place among all that are taken is the slot. The key kept in the slot verifies a look-up.
    """

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.keys = np.zeros_like(keys)
        left, first = keys, 0
        while len(left):
            place = self._place(left, len(self.levels), 2 * len(left))
            alone = np.bincount(place, minlength=2 * len(left)) == 1
            rank = np.cumsum(alone) - 1
            stays = alone[place]
            self.keys[first + rank[place[stays]]] = left[stays]
            self.levels.append((alone, rank, first))
            first += int(stays.sum())
            left = left[~stays]

    @staticmethod
    def _place(keys: np.ndarray, level: int, places: int) -> np.ndarray:
        return (mix(keys[:, 0] ^ mix(keys[:, 1] + np.uint64(level + 1))) % np.uint64(places)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that are not there."""
        slot = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (alone, rank, first) in enumerate(self.levels):
            place = self._place(keys[open_], level, len(alone))
            here = alone[place]
            slot[open_[here]] = first + rank[place[here]]
            open_ = open_[~here]
        found = slot >= 0
        found[found] = (self.keys[slot[found]] == keys[found]).all(1)
        return np.where(found, slot, -1)


_OUT = "g1 long, g2 long, saved long, leaves long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long"


def _added_up(table: pa.Table) -> pa.Table:
    """One shard: counts scattered into slots, added to the parents' from the deepest on; the owned nodes with their facts."""
    get = {name: table.column(name).to_numpy() for name in table.column_names if name != "owned"}
    keys = np.stack([get["g1"], get["g2"]], 1).view(np.uint64)
    # rows of a digest differ in what they bring; the first in this order has the node's facts
    order = np.lexsort((-get["real"], keys[:, 1], keys[:, 0]))
    first = np.ones(len(order), bool)
    first[1:] = (keys[order[1:]] != keys[order[:-1]]).any(1)
    nodes = order[first]
    slots = Slots(keys[nodes])
    node_slot = slots.find(keys[nodes])
    facts = np.empty(len(nodes), np.int64)
    facts[node_slot] = nodes
    at = slots.find(keys)
    saved, leaves = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
    np.add.at(saved, at, get["s0"])
    np.add.at(leaves, at, get["l0"])
    depth = get["d"][facts]
    parent = slots.find(np.stack([get["p1"][facts], get["p2"][facts]], 1).view(np.uint64))
    top = depth.min()
    deepest = np.argsort(-depth, kind="stable")
    for level in np.split(deepest, np.flatnonzero(np.diff(depth[deepest])) + 1):
        if depth[level[0]] > top:
            np.add.at(saved, parent[level], saved[level])
            np.add.at(leaves, parent[level], leaves[level])
    # the last node of the unit before is there for its facts only
    own = np.flatnonzero(get["real"][facts] > 0)
    owned = table.column("owned").to_numpy()[facts[own]]

    def fact(values: np.ndarray, there: np.ndarray) -> pa.Array:
        return pa.array(values, mask=~there)

    up = parent[own]
    has = owned & (depth[own] > 0)
    return pa.table([
        pa.array(slots.keys[own, 0].view(np.int64)), pa.array(slots.keys[own, 1].view(np.int64)), pa.array(saved[own]), pa.array(leaves[own]),
        fact(get["conv_id"][facts[own]], owned), fact(depth[own], owned), fact(get["conv_id"][facts[np.maximum(up, 0)]], has),
        fact(get["n_convs"][facts[own]], owned), fact(get["n_children"][facts[own]], owned)], names=[c.split()[0] for c in _OUT.split(", ")])


def _ends(ends: DataFrame) -> DataFrame:
    """(g1, g2, ends_sha256): digests of the ascending ids that end at a node, joined by commas.

    Ids are joined for ranges of them first; the ranges of a node stream through the digest in order.
    """
    ranges = ends.groupBy("g1", "g2", F.shiftright("c", _IDS_BITS).alias("part")).agg(F.sort_array(F.collect_list("c")).alias("ids"))
    texts = ranges.select("g1", "g2", "part", F.array_join(F.transform("ids", lambda c: c.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            out = []
            for g1, g2, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if (g1, g2) == last:
                    state.update(b"," + ids.encode())
                else:
                    if last:
                        out.append((*last, state.hexdigest()))
                    last, state = (g1, g2), hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["g1", "g2", "ends_sha256"])
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([last[1]]), pa.array([state.hexdigest()])], names=["g1", "g2", "ends_sha256"])

    return texts.repartition("g1", "g2").sortWithinPartitions("g1", "g2", "part").mapInArrow(digest, "g1 long, g2 long, ends_sha256 string")


def _shard(c: Column, unit: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(c, unit), F.lit(shards))


def trie(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row per distinct beginning of the sequences ``rows`` (c, d, t1, t2, bytes) of the members ``lengths`` (c, n_turns).

    Columns: g1, g2 (the digest; 0, 0 at the root), conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    bounded_batches(rows.sparkSession)
    prefixes = stored(_prefixes(rows), "prefixes")
    shards = max(1, -(-prefixes.count() // SHARD_ROWS))
    zero = F.lit(0).cast("long")
    dealt = prefixes.withColumn("shard", _shard(F.col("c"), F.col("unit"), shards))
    root = lengths.select(zero.alias("unit"), _shard(F.col("c"), zero, shards).alias("shard"), zero.alias("g1"), zero.alias("g2"), "c",
                          zero.alias("p1"), zero.alias("p2"), zero.alias("d"), zero.alias("bytes"))
    every = dealt.select(root.columns).unionByName(root).withColumn("facts", F.xxhash64("p1", "p2", "d", "bytes"))
    same = [F.first(x).alias(x) for x in ("p1", "p2", "d", "bytes")]
    local = stored(every.groupBy("unit", "shard", "g1", "g2").agg(F.count("*").alias("n"), F.min("c").alias("c"), *same, F.min("facts").alias("low"), F.max("facts").alias("high")), "shard-nodes")
    nodes = local.groupBy("g1", "g2").agg(F.sum("n").alias("n_convs"), F.min("c").alias("conv_id"), F.min_by("shard", "c").alias("owner"), *same,
                                          F.min("low").alias("low"), F.max("high").alias("high"))
    checked = F.when(F.col("low") == F.col("high"), F.col("n_convs")).otherwise(F.raise_error(F.lit("two beginnings share a digest")).cast("long"))
    children = nodes.filter("d > 0").groupBy(F.col("p1").alias("g1"), F.col("p2").alias("g2")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.withColumn("n_convs", checked).join(children, ["g1", "g2"], "left").select(
        "g1", "g2", "n_convs", "conv_id", "owner", "d", "bytes", F.coalesce("n_children", zero).alias("n_children")), "nodes")

    globally = nodes.select("g1", "g2", "n_convs", "conv_id", "owner", "n_children")
    owned = F.col("owner") == F.col("shard")
    real = local.join(globally, ["g1", "g2"]).select(
        "unit", "shard", "g1", "g2", "p1", "p2", "d", ((F.col("n") - owned.cast("long")) * F.col("bytes")).alias("s0"),
        (owned & (F.col("n_children") == 0)).cast("long").alias("l0"), owned.alias("owned"), "conv_id", "n_convs", "n_children", F.lit(1).cast("long").alias("real"))
    # the cuts of long conversations: the last node before a cut, and what comes after it
    cuts = prefixes.filter((F.col("unit") > 0) & (F.col("d") - 1 == F.shiftleft("unit", UNIT_BITS))).select("c", "unit", F.col("p1").alias("g1"), F.col("p2").alias("g2"))
    before = cuts.select("unit", _shard(F.col("c"), F.col("unit"), shards).alias("shard"), "g1", "g2").distinct().join(globally, ["g1", "g2"])
    facts = [zero.alias("p1"), zero.alias("p2"), F.shiftleft("unit", UNIT_BITS).alias("d")]
    seen = before.select("unit", "shard", "g1", "g2", *facts, zero.alias("s0"), zero.alias("l0"), F.lit(False).alias("owned"), "conv_id", "n_convs", "n_children", zero.alias("real"))
    unit = F.shiftright(F.col("d") - 1, UNIT_BITS).alias("unit")
    turns = prefixes.filter("unit > 0").groupBy("c", "unit").agg(F.sum("bytes").alias("all"))
    mine = nodes.filter(unit > 0).groupBy(F.col("conv_id").alias("c"), unit).agg(F.sum("bytes").alias("own"), F.count_if(F.col("n_children") == 0).alias("leaves"))
    rest = turns.join(mine, ["c", "unit"], "left").select("c", "unit", (F.col("all") - F.coalesce("own", zero)).alias("s"), F.coalesce("leaves", zero).alias("l"))
    onward = Window.partitionBy("c").orderBy(F.desc("unit")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = rest.select("c", "unit", F.sum("s").over(onward).alias("s0"), F.sum("l").over(onward).alias("l0")).join(cuts, ["c", "unit"])
    earlier = F.col("unit") - 1
    carried = carried.select(earlier.alias("unit"), _shard(F.col("c"), earlier, shards).alias("shard"), "g1", "g2", *(zero.alias(x) for x in ("p1", "p2", "d")), "s0", "l0",
                             F.lit(False).alias("owned"), *(zero.alias(x) for x in ("conv_id", "n_convs", "n_children")), zero.alias("real"))
    sums = real.unionByName(seen).unionByName(carried).groupBy("unit", "shard").applyInArrow(_added_up, _OUT)
    total = sums.groupBy("g1", "g2").agg(F.max("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_conv_id").alias("parent_conv_id"),
                                         F.max("n_convs").alias("n_convs"), F.max("n_children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    last = prefixes.join(lengths, "c").filter("d = n_turns").select("c", "g1", "g2").unionByName(
        lengths.filter("n_turns = 0").select("c", zero.alias("g1"), zero.alias("g2")))
    nothing = hashlib.sha256(b"").hexdigest()
    return total.join(_ends(last), ["g1", "g2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(nothing)))


def prefix_nodes(conversations: DataFrame) -> DataFrame:
    """The nodes of the rebuilt conversations."""
    return trie(*rebuilt(conversations)).drop("g1", "g2")
