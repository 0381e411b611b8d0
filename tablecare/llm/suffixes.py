"""Removal of byte strings that occur earlier, by a sample of suffixes that covers all others.

Every string of SIZE bytes is represented by the least hash among its seeds (strings of SEED bytes). Equal strings have
the same least seed, wherever they stand; so seeds play the part of the residues of a difference cover, which would have
to keep two thirds of all suffixes. The neighbouring strings that share one seed's place are a block.

1. Sampled suffixes: one for each block, cut to the block's depth. Blocks whose seed occurs once can hold no repeat and
   are left out. The others are named by their triple: seed, first and last string (which together are all its bytes).
2. Of each name the first occurrence, in order of document and place, is found; the strings of all others occur earlier.
3. The first occurrences of blocks whose seed has several names go on to the next round, where the same is done with
   parts of SUB strings: those are left out whose common bytes no other part has, the others are named, the first of each
   name is found, and first parts go on whose common bytes have several names.
4. Remaining suffixes: the strings of these parts meet in their bytes; next to each other, equal ones show which is later.
5. What is covered by strings found in 2, 3 and 4 is removed.

Hot strings are combined in each task to one row before they are shuffled; the joins back to occurrences are plain
equi-joins, which Spark splits. A long text is handled in slices, since blocks may be cut anywhere.

Null and empty texts have nothing to remove. A null id comes before all others. Every row is a document of its own: those
that share an id, or have none, follow each other by the digests of their texts. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecare.llm.links import discard, passes, sized_filter, stored
from tablecare.llm.text import Texts, bounded_batches, map_texts, mix, tidied

SIZE = 100
SEED = 40
#: Strings of a part of a block.
SUB = 8
NO_ID = -(2**63)
#: Bytes of text of a step: little enough to stay near the processor.
STEP = 1 << 18
SLICE = 4 << 20

_FACTORS = mix(np.arange(1, SIZE // 8 + 3, dtype=np.uint64)) | np.uint64(1)
#: Low bits that hold a place within a slice.
_LOW = np.uint64((1 << 23) - 1)
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one integer; zeros follow the end."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(16 + -n % 8, np.uint8)])
    out = np.empty(n + -n % 8, np.uint64)
    for r in range(8):
        out[r::8] = np.frombuffer(padded, np.uint64, len(out) // 8, r)
    return out[:n]


def _hashed(eights: np.ndarray, at: np.ndarray | slice, size: int) -> np.ndarray:
    """A hash of ``size`` bytes (8 at least) at each place."""
    total = np.zeros(len(eights) - size + 8 if isinstance(at, slice) else len(at), np.uint64)
    for i, j in enumerate([*range(0, size - 8, 8), size - 8]):
        total += (eights[j : j + len(total)] if isinstance(at, slice) else eights[at + j]) * _FACTORS[i]
    return mix(total)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


class Blocks:
    """Blocks of the texts: row, start within the row, number of strings, seed, how far ahead of the start it is, and name."""

    def __init__(self, part: Texts):
        found: list[tuple[np.ndarray, ...]] = []
        self.part, self.found = part, found
        edges = part.offs
        if len(part) == 1 and len(part.data) > SLICE:
            for first in range(0, len(part.data) - SIZE + 1, SLICE):
                self._add(part.data[first : first + SLICE + SIZE - 1], np.array([0, min(SLICE + SIZE - 1, len(part.data) - first)]), first)
        else:
            self._add(part.data, edges, 0)
        self.row, self.start, self.many, self.seed, self.ahead, self.name = (
            np.concatenate([x[i] for x in found]) if found else np.zeros(0, kind)
            for i, kind in enumerate((np.int64, np.int64, np.int64, np.uint64, np.int64, np.uint64)))

    def _add(self, data: np.ndarray, offs: np.ndarray, base: int) -> None:
        n = len(data) - SIZE + 1
        if n <= 0:
            return
        eights = _eights(data)
        seeds = _hashed(eights, slice(None), SEED)
        # the least seed of each string, the first of equals: where it stands is kept in the low bits
        place = (_least((seeds & ~_LOW) | np.arange(len(seeds), dtype=np.uint64), SIZE - SEED + 1)[:n] & _LOW).astype(np.int64)
        row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:n]
        last = (offs[1:] - SIZE)[row]  # the last string of the row
        begins = np.ones(n, bool)
        begins[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
        begins &= np.arange(n) <= last
        starts = np.flatnonzero(begins)
        ends = np.minimum(np.append(starts[1:], n), last[starts] + 1)
        seed, ahead = seeds[place[starts]], place[starts] - starts
        name = mix(_hashed(eights, starts, SIZE) * _B + _hashed(eights, ends - 1, SIZE) * _C + (ends - starts).astype(np.uint64))
        self.found.append((row[starts], starts - offs[row[starts]] + base, ends - starts, seed, ahead, name))

    def filter(self, keep: np.ndarray) -> None:
        for name in ("row", "start", "many", "seed", "ahead", "name"):
            setattr(self, name, getattr(self, name)[keep])


def _marks(name: np.ndarray, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    """One number for a name at a place."""
    return mix(name ^ mix(ids.view(np.uint64)) ^ start.astype(np.uint64) * _D).view(np.int64)


def keyed(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``__id``, a long that is never null, and ``__tag``; both together name a row and order the rows.

    Rows whose id is theirs alone have the tag -1. The others are stored in order of id, digest of the text and row, and
    numbered once.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    whole = docs.withColumn("__id", F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)))
    several = whole.groupBy("__id").agg(F.count("*").alias("n")).filter((F.col("n") > 1) | (F.col("__id") == NO_ID))
    found = _filter(several.select("__id"))
    no_tag = F.lit(-1).cast("long")
    if not found.any():
        return whole.withColumn("__tag", no_tag)
    shared, at = spark.sparkContext.broadcast(found), len(docs.columns)

    def those(wanted: bool):
        def run(batches):
            for b in batches:
                yield b.filter(pa.array(passes(shared.value, b.column(at).to_numpy()) == wanted))

        return run

    alone = whole.mapInArrow(tidied(those(False)), whole.schema).withColumn("__tag", no_tag)
    some = whole.mapInArrow(tidied(those(True)), whole.schema).withColumn("__row", F.monotonically_increasing_id())
    some = some.orderBy(F.col(id_column).cast("long").asc_nulls_first(), F.sha2(F.col(text).cast("binary"), 256), "__row").drop("__row")
    return alone.unionByName(stored(some.withColumn("__tag", F.monotonically_increasing_id()), "shared"))


def _filter(ids: DataFrame) -> np.ndarray:
    """A filter of ids that are yet to be worked out."""
    held = stored(ids, "ids")
    found = sized_filter(held)
    discard(held)
    return found


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _keys(part: Texts, row: np.ndarray) -> list[pa.Array]:
    """Id and tag of these rows."""
    return [pa.array(part.rows.column(i).to_numpy()[row]) for i in (0, 1)]


def _place() -> Column:
    return F.struct("id", "tag", "start")


def _subs(blocks: Blocks) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parts of SUB strings that the blocks fall into, counted by how far ahead their seed is.

    Returns the block of each part, its first string and number of strings, the place of the bytes that all strings of a
    whole part have in common, and its key. A part can hold a repeat only if these bytes occur with another block's part.
    """
    high, low = blocks.ahead // SUB, (blocks.ahead - blocks.many + 1) // SUB
    n = high - low + 1
    of = np.repeat(np.arange(len(n)), n)
    sub = high[of] - (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))
    seed_at = blocks.part.offs[blocks.row[of]] + blocks.start[of] + blocks.ahead[of]
    common = seed_at - sub * SUB  # where the part's last string starts; the bytes before the end of its first are common
    first = np.maximum(blocks.ahead[of] - sub * SUB - SUB + 1, 0)
    many = np.minimum(blocks.ahead[of] - sub * SUB, blocks.many[of] - 1) - first + 1
    eights = _eights(blocks.part.data)
    size = SIZE - SUB + 1
    key = mix(_hashed(eights, common, size) ^ blocks.seed[of] ^ sub.astype(np.uint64) * _A)
    return of, first, many, common, key


def repeated(rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(id, tag, first, end) of byte ranges of texts that occur earlier; ranges overlap. And the tables that they are read from. ``rows``: id, tag, text."""
    spark = rows.sparkSession

    def seeds(part: Texts) -> pa.RecordBatch:
        seed, seen = np.unique(Blocks(part).seed, return_counts=True)
        return pa.RecordBatch.from_arrays([_signed(seed), pa.array(seen)], names=["seed", "seen"])

    # by all bits: seeds are least of many, so few of their upper bits differ
    counted = map_texts(rows, seeds, "seed long, seen long", step=STEP).groupBy("seed").agg(F.sum("seen").alias("seen")).filter("seen > 1")
    twice = spark.sparkContext.broadcast(_filter(counted.select("seed")))

    def shared(part: Texts) -> Blocks:
        blocks = Blocks(part)
        blocks.filter(passes(twice.value, blocks.seed.view(np.int64)))
        return blocks

    def sample(part: Texts) -> pa.RecordBatch:
        blocks = shared(part)
        return pa.RecordBatch.from_arrays(
            [_signed(blocks.seed), _signed(blocks.name), *_keys(part, blocks.row), pa.array(blocks.start), pa.array(blocks.many.astype(np.int32))],
            names=["seed", "name", "id", "tag", "start", "many"])

    sampled = stored(map_texts(rows, sample, "seed long, name long, id long, tag long, start long, many int", step=STEP), "blocks")
    named = stored(sampled.groupBy("seed", "name").agg(F.min(_place()).alias("first"), F.count("*").alias("seen")), "names")
    # other occurrences of a name
    later = sampled.join(named.filter("seen > 1").select("name", "seed", "first"), ["seed", "name"]).filter(
        _place() != F.col("first")).select("id", "tag", F.col("start").alias("first"), (F.col("start") + F.col("many") + SIZE - 1).alias("end"))
    later = stored(later, "later")
    # first occurrences of seeds with more than one name
    mixed = named.groupBy("seed").agg(F.count("*").alias("names")).filter("names > 1").select("seed")
    ask = stored(named.join(mixed, "seed").select("name", "first.*"), "firsts")
    firsts, texts_of = _filters(ask)
    discard(sampled, named, ask)

    def asked(part: Texts) -> Blocks | None:
        """The first occurrences among the blocks, of the texts that have any."""
        part = part.taken(np.flatnonzero(passes(texts_of.value, part.rows.column(0).to_numpy())))
        if not len(part):
            return None
        blocks = shared(part)
        blocks.filter(passes(firsts.value, _marks(blocks.name, part.rows.column(0).to_numpy()[blocks.row], blocks.start)))
        return blocks

    def cores(part: Texts) -> pa.RecordBatch | None:
        blocks = asked(part)
        return None if blocks is None else pa.RecordBatch.from_arrays([_signed(_subs(blocks)[4])], names=["core"])

    common = map_texts(rows, cores, "core long", step=STEP).groupBy("core").agg(F.count("*").alias("seen")).filter("seen > 1")
    kept = spark.sparkContext.broadcast(_filter(common.select("core")))

    def parts(part: Texts) -> tuple[Texts, np.ndarray, ...] | None:
        """Row, first string, number of strings, core and name of the parts whose common bytes others have."""
        blocks = asked(part)
        if blocks is None:
            return None
        block, first, many, _, core = _subs(blocks)
        use = passes(kept.value, core.view(np.int64))
        block, first, many, core = block[use], first[use], many[use], core[use]
        start = blocks.start[block] + first
        row, eights = blocks.row[block], _eights(blocks.part.data)
        at = blocks.part.offs[row] + start
        name = mix(_hashed(eights, at, SIZE) * _B + _hashed(eights, at + many - 1, SIZE) * _C + many.astype(np.uint64))
        return blocks.part, row, start, many, core, name

    def second(part: Texts) -> pa.RecordBatch | None:
        found = parts(part)
        if found is None:
            return None
        part, row, start, many, core, name = found
        return pa.RecordBatch.from_arrays(
            [_signed(core), _signed(name), *_keys(part, row), pa.array(start), pa.array(many.astype(np.int32))], names=["core", "name", "id", "tag", "start", "many"])

    sampled = stored(map_texts(rows, second, "core long, name long, id long, tag long, start long, many int", step=STEP), "parts")
    named = stored(sampled.groupBy("core", "name").agg(F.min(_place()).alias("first"), F.count("*").alias("seen")), "names")
    again = sampled.join(named.filter("seen > 1").select("core", "name", "first"), ["core", "name"]).filter(
        _place() != F.col("first")).select("id", "tag", F.col("start").alias("first"), (F.col("start") + F.col("many") + SIZE - 1).alias("end"))
    again = stored(again, "later")
    mixed = named.groupBy("core").agg(F.count("*").alias("names")).filter("names > 1").select("core")
    ask = stored(named.join(mixed, "core").select("name", "first.*"), "firsts")
    lasts, _ = _filters(ask)
    discard(sampled, named, ask)

    def remaining(part: Texts) -> pa.RecordBatch | None:
        found = parts(part)
        if found is None:
            return None
        part, row, start, many, _, name = found
        use = passes(lasts.value, _marks(name, part.rows.column(0).to_numpy()[row], start))
        row, start, many = row[use], start[use], many[use]
        of = np.repeat(np.arange(len(row)), many)
        start = start[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        row = row[of]
        string = _hashed(_eights(part.data), part.offs[row] + start, SIZE)
        return pa.RecordBatch.from_arrays([_signed(string), *_keys(part, row), pa.array(start)], names=["string", "id", "tag", "start"])

    strings = stored(map_texts(rows, remaining, "string long, id long, tag long, start long", step=STEP), "strings")
    ordered = strings.groupBy("string").agg(F.count("*").alias("seen"), F.min(_place()).alias("first")).filter("seen > 1")
    other = strings.join(ordered, "string").filter(_place() != F.col("first")).select("id", "tag", F.col("start").alias("first"), (F.col("start") + SIZE).alias("end"))
    return later.unionByName(again).unionByName(other), [later, again, strings]


def _filters(firsts: DataFrame) -> tuple:
    """Of first occurrences (name, id, tag, start): filters of the names at their places, and of the texts."""
    def marks(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_marks(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), b.column(2).to_numpy()))], names=["mark"])

    context = firsts.sparkSession.sparkContext
    return (context.broadcast(sized_filter(firsts.select("name", "id", "start").mapInArrow(tidied(marks), "mark long"))), context.broadcast(sized_filter(firsts.select("id"))))


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", digest_only: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept, and the columns ``carry``) per row of ``docs``.

    ``kept`` is the remaining bytes; characters that the removal cuts in two are left out of it. ``digest_only`` leaves it null.
    """
    spark = docs.sparkSession
    base = keyed(docs.select(id_column, *carry, text), id_column, text)
    rest = F.struct(id_column, *carry).alias("rest")
    told_of = base.select(F.col("__id").alias("id"), F.col("__tag").alias("tag"), rest, F.col(text).alias("text"))
    rows = told_of.select("id", "tag", "text")
    kind = told_of.schema["rest"].dataType.simpleString()
    found, tables = repeated(rows)
    cuts = stored(found.groupBy("id", "tag").agg(F.collect_list(F.struct("first", "end")).alias("cuts")), "cuts")
    discard(*tables)
    touched = spark.sparkContext.broadcast(sized_filter(cuts.select("id")))
    schema = f"id long, tag long, rest {kind}, n_bytes long, digest string, text string"

    def split(part: Texts) -> pa.RecordBatch:
        """Texts that may be cut go on as texts, the others as what is to be told of them."""
        ids = part.rows.column(0).to_numpy()
        cut = passes(touched.value, ids)
        raw = part.data.tobytes()
        own = [raw[a:b] for a, b in zip(part.offs[:-1].tolist(), part.offs[1:].tolist())]
        return pa.RecordBatch.from_arrays(
            [*part.rows.columns[:3], pa.array(np.diff(part.offs)), pa.array([None if c else hashlib.sha256(x).hexdigest() for c, x in zip(cut, own)], pa.string()),
             pa.array([x if c or not digest_only else None for c, x in zip(cut, own)], pa.binary()).cast(pa.string())], names=["id", "tag", "rest", "n_bytes", "digest", "text"])

    told = map_texts(told_of, split, schema)
    whole = told.filter("digest is not null").select("n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("digest").alias("kept_sha256"), F.col("text").alias("kept"), "rest")

    def remove(batches):
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                raw = batch.column(0)[i].as_py().encode()
                ranges = batch.column(1)[i]
                covered = np.zeros(len(raw) + 1, np.int64)
                if ranges.is_valid:
                    flat = ranges.values
                    np.add.at(covered, np.minimum(flat.field(0).to_numpy(), len(raw)), 1)
                    np.add.at(covered, np.minimum(flat.field(1).to_numpy(), len(raw)), -1)
                gone = np.cumsum(covered)[:-1] > 0
                left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])) if len(raw) else 0
                out.append((len(raw), int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), None if digest_only else left.decode("utf-8", "ignore")))
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:]), batch.column(2)],
                                             names=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "rest"])

    cut = told.filter("digest is null").select("id", "tag", "rest", "text").join(cuts, ["id", "tag"], "left").select("text", "cuts", "rest").mapInArrow(
        tidied(remove), f"n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string, rest {kind}")
    both = whole.unionByName(cut)
    return both.select(F.col(f"rest.{id_column}").alias(id_column), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", *(F.col(f"rest.{c}").alias(c) for c in carry))
