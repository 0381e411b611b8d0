"""Code length of texts by context-tree weighting over bytes.

A byte is coded as eight binary decisions, the highest bit first. Each of the 255 places in a byte where a decision is made
has a binary source with a context tree of its own: its node at depth d is named by the d bytes before the byte. A node has
the Krichevsky-Trofimov estimate of the zeros and ones seen there; its weighted probability is half that of its own
estimate and half the product of its children's. So all depths are mixed with the weights that the training texts earn them.

Texts are dealt to blocks of some megabytes as they are read, and each block says once which strings of DEPTH + 1 bytes it
holds and how often training texts hold them. Strings are dealt to buckets by the SPLIT bytes before their last byte, so the
nodes of deeper contexts are all in one bucket and are worked out there, from the strings themselves, without rows of their
own. Nodes of shorter contexts are summed depth by depth in grouped aggregates. Back down, every bucket gets what the nodes
above it contribute, gives each of its strings a cost, and each block the costs of the strings it asked for; the block's
texts then meet that list. Strings that only held-out texts have are nodes without counts, which code a bit with 1/2 and change
no other node. The model never passes through the driver, and a task holds one block's list or one bucket's strings. What is
stored and shuffled, texts too, travels compressed and many to a row; costs travel as 32-bit floats, a relative error under 1e-7.

Beside it, the base: unigram probabilities of words, smoothed. Words take the same way as strings, with counts for costs.

Texts are scored in lower case (A-Z), with a zero byte as their end. Null and empty texts have the end alone. A text whose
id is null is scored but not learned from. Rows are scored each for itself, repeated ones too; a very long text is a block of
its own and is worked through in steps. Without training texts each bit costs one bit. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.llm.links import discard, stored
from tablecare.llm.text import Texts, bounded_batches, crc_fold, give_back, mix, span_hashes, texts, tidied

#: Bytes of the longest context: with 6, a string and a bit beside it fit 64-bit keys.
DEPTH = 6
#: Bytes of the contexts that buckets are dealt by: a bucket's context has at most 2 ** (8 * (DEPTH - SPLIT + 1)) strings.
SPLIT = 4
FOLDS, HELD = 10, 0
#: Bytes of text of a block, which asks once for each string it holds.
BLOCK_BYTES = 48 << 20
#: Bytes of text for which there is one bucket of strings and one of words.
BUCKET_BYTES = 8 << 20
STEP = 1 << 19
#: Level of compression of texts.
LEVEL = 6
END = np.uint64(0xE17A1465E17A1465 >> 1)

#: Kinds of rows that meet: strings or words, a bucket's parents, what a block asks for; texts.
STRINGS, WORDS, TEXT = 0, 1, 2

_LN2 = np.log(2)
_TABLED = 1 << 16
_HALVES = 0.5 * np.log(np.pi) + np.concatenate([[0.0], np.cumsum(np.log(np.arange(_TABLED - 1) + 0.5))])
_WHOLES = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _TABLED)))])


def _lgamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function of large numbers, by Stirling's series."""
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def _tabled(table: np.ndarray, counts: np.ndarray, plus: float) -> np.ndarray:
    out = table[np.minimum(counts, _TABLED - 1)]
    large = counts >= _TABLED
    if large.any():
        out[large] = _lgamma(counts[large] + plus)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts (integers)."""
    return _tabled(_HALVES, zeros, 0.5) + _tabled(_HALVES, ones, 0.5) - _tabled(_WHOLES, zeros + ones, 1.0) - np.log(np.pi)


def strings(part: Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The string at each byte of the lower-cased texts and their ends, and its row, in steps.

    A string is a number: the DEPTH bytes before the byte, the nearest one highest, and the byte lowest.
    """
    low = part.lower()
    n = np.diff(low.offs) + 1
    wide = n + DEPTH  # zeros before the text, a zero after it
    starts = np.cumsum(wide) - wide
    own = np.ones(int(wide.sum()), bool)
    own[(starts[:, None] + np.arange(DEPTH)).ravel()] = False
    filled = own.copy()
    filled[starts + wide - 1] = False
    data = np.zeros(len(own), np.uint8)
    data[filled] = low.data
    ends = np.cumsum(n)
    done = 0
    for first in range(0, len(data) - DEPTH, STEP):
        d = data[first : first + STEP + DEPTH].astype(np.uint64)
        two = d[1:-1] << np.uint64(8) | d[:-2]  # one byte fewer than there is: the last is never a context
        four = two[2:] << np.uint64(16) | two[:-2]
        six = two[4:] << np.uint64(32) | four[: len(two) - 4]
        keys = (six << np.uint64(8) | d[DEPTH:])[own[first + DEPTH : first + STEP + DEPTH]]
        counts = np.clip(np.minimum(ends, done + len(keys)) - np.maximum(ends - n, done), 0, None)
        yield keys, np.repeat(np.arange(len(n)), counts)
        done += len(keys)


def words(part: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (63 bits) and rows of the words, with one end for each row."""
    low = part.lower()
    starts, ends, rows = low.words()
    hashes = span_hashes(low.data, starts, ends) >> np.uint64(1)
    return np.concatenate([hashes, np.full(len(part), END)]), np.concatenate([rows, np.arange(len(part))])


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(first)


class Tally:
    """Distinct keys and how often they were counted; a key may be there without being counted."""

    MERGED_AT = 1 << 20
    #: Keys of the longest list that are merged with their likes at once.
    PIECE = 1 << 16

    def __init__(self, kind: type = np.uint64):
        self.kind = kind
        self.keys, self.n, self.waiting = [], [], 0

    def see(self, keys: np.ndarray, counted: np.ndarray) -> None:
        both = np.sort(keys << np.uint64(1) | counted)
        at = _firsts(both >> np.uint64(1))
        if len(at):
            self.add(both[at] >> np.uint64(1), np.add.reduceat(both & np.uint64(1), at).astype(self.kind))

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.keys.append(keys)
        self.n.append(n)
        self.waiting += len(keys)
        if self.waiting > self.MERGED_AT and len(self.keys) > 1 and self.waiting > 2 * len(self.keys[0]):
            self.result()

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros(0, self.kind)
        if len(self.keys) > 1:  # all lists ascend: range by range of keys
            cuts = max(self.keys, key=len)[self.PIECE :: self.PIECE]
            edges = [[0, *np.searchsorted(k, cuts).tolist(), len(k)] for k in self.keys]
            done = []
            for i in range(len(cuts) + 1):
                keys, n = (np.concatenate([x[e[i] : e[i + 1]] for x, e in zip(some, edges)]) for some in (self.keys, self.n))
                order = np.argsort(keys, kind="stable")
                keys, n = keys[order], n[order]
                at = _firsts(keys)
                if len(at):
                    done.append((keys[at], np.add.reduceat(n, at, dtype=self.kind)))
            self.keys = [np.concatenate([k for k, _ in done])]
            self.n = [np.concatenate([n for _, n in done])]
            self.waiting = len(self.keys[0])
        return self.keys[0], self.n[0]


def _tallies() -> tuple[Tally, Tally]:
    """Those of a block, strings and words; a block's counts fit 32 bits as long as no text has 4 GB."""
    return Tally(np.uint32), Tally(np.uint32)


def pack(values: np.ndarray, kind: str = "<u8") -> bytes:
    """Numbers by planes of equal bytes, which compress well."""
    width = np.dtype(kind).itemsize
    return len(values).to_bytes(8, "little") + pa.Codec("zstd").compress(values.astype(kind).view(np.uint8).reshape(-1, width).T.tobytes(), asbytes=True)


def unpack(raw: bytes, kind: str = "<u8") -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = pa.Codec("zstd").decompress(raw[8:], decompressed_size=width * int.from_bytes(raw[:8], "little"))
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending numbers as the steps between them."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def pack_rows(rows: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))) as stream:
        stream.write_batch(rows)
    return out.getvalue().to_pybytes()


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw), dtype=np.uint64)


class Tree:
    """The nodes with contexts of SPLIT to DEPTH bytes over ascending strings and their counts, for all eight bits of a byte."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        n = n.astype(np.int64)
        self.levels = [(keys, n, None)]  # the deepest first; for each string of a level its string one byte shorter
        for _ in range(DEPTH - SPLIT):
            short = keys >> np.uint64(16) << np.uint64(8) | keys & np.uint64(255)
            order = np.argsort(short, kind="stable")
            ranked = short[order]
            at = _firsts(ranked)
            up = np.empty(len(keys), np.int64)
            up[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(keys))))
            keys, n = ranked[at], np.add.reduceat(n[order], at)
            self.levels[-1] = (*self.levels[-1][:2], up)
            self.levels.append((keys, n, None))

    def bit(self, i: int) -> list[tuple]:
        """Nodes of the i-th bit by level: (node of each string, first string, parent, zeros, ones, whole, stop)."""
        out, whole, parent = [], None, None
        for depth, (keys, n, up) in enumerate(self.levels):
            at = _firsts(keys >> np.uint64(8 - i))
            node = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(keys))))
            ones = np.add.reduceat(n * (keys >> np.uint64(7 - i) & np.uint64(1)).astype(np.int64), at)
            zeros = np.add.reduceat(n, at) - ones
            own = log_kt(zeros, ones)
            if depth:
                below = np.bincount(node[parent], weights=whole, minlength=len(at))
                out[-1][2] = node[parent]
                whole = np.logaddexp(own, below) - _LN2
                stop = np.exp(np.minimum(own - _LN2 - whole, 0))
            else:
                whole, stop = own, np.ones(len(at))
            out.append([node, at, None, zeros, ones, whole, stop])
            parent = up[at] if up is not None else None
        return out

    def named(self, i: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Context and place of the nodes of the i-th bit at the top level."""
        keys = self.levels[-1][0][at]
        return keys >> np.uint64(8), keys >> np.uint64(8 - i) & np.uint64((1 << i) - 1) | np.uint64(1 << i)

    def tops(self) -> list[tuple[np.ndarray, ...]]:
        """(context, place, zeros, ones, whole) of the nodes with SPLIT bytes."""
        found = []
        for i in range(8):
            _, at, _, zeros, ones, whole, _ = self.bit(i)[-1]
            found.append((*self.named(i, at), zeros, ones, whole))
        return [np.concatenate(x) for x in zip(*found)]

    def costs(self, names: np.ndarray, sums: np.ndarray, rests: np.ndarray) -> np.ndarray:
        """log10 of the probability of each string's last byte; given what stands above the top nodes, by context and place."""
        order = np.argsort(names)
        names, sums, rests = names[order], sums[order], rests[order]
        keys = self.levels[0][0]
        total = np.zeros(len(keys))
        for i in range(8):
            levels = self.bit(i)
            context, place = self.named(i, levels[-1][1])
            where = np.searchsorted(names, context << np.uint64(8) | place)
            one, rest = sums[where], rests[where]
            for depth in range(len(levels) - 1, -1, -1):
                _, _, parent, zeros, ones, _, stop = levels[depth]
                if depth < len(levels) - 1:
                    one, rest = one[parent], rest[parent]
                one = one + rest * stop * ((ones + 0.5) / (zeros + ones + 1.0))
                rest = rest * (1 - stop)
            node = levels[0][0]
            bit = keys >> np.uint64(7 - i) & np.uint64(1)
            total += np.where(bit == 1, np.log10(one)[node], np.log10(1 - one)[node])
        return total


class Lookup:
    """Values of some keys, one at least, all asked for among them: two tables of slots, and a search for those whose places are taken.

    The lists of keys and values are taken over and emptied, so that the keys are held twice at most while they are put in order.
    """

    #: Keys whose slots are worked out at once.
    RANGE = 1 << 18

    def __init__(self, lists: list[tuple[np.ndarray, np.ndarray]]):
        keys, values = np.concatenate([k for k, _ in lists]), np.concatenate([v for _, v in lists])
        lists.clear()
        order = np.argsort(keys)
        self.values = values[order]
        del values, order
        keys.sort()
        self.keys = keys
        self.tables = []  # places of keys by slot; several keys have the same slot, one of them is there
        left = np.arange(len(self.keys), dtype=np.int32)
        for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            bits = max(8, len(left).bit_length())
            places = np.zeros(1 << bits, np.int32)
            some = [left[i : i + self.RANGE] for i in range(0, len(left), self.RANGE)]
            for at in some:
                places[self._slot(self.keys[at], factor, bits)] = at
            self.tables.append((factor, bits, places))
            left = np.concatenate([left[:0], *(at[places[self._slot(self.keys[at], factor, bits)] != at] for at in some)])

    @staticmethod
    def _slot(keys: np.ndarray, factor: int, bits: int) -> np.ndarray:
        return (keys * np.uint64(factor) >> np.uint64(64 - bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        first, second = self.tables
        at = self._place(keys, *first)
        miss = np.flatnonzero(self.keys[at] != keys)
        at[miss] = self._place(keys[miss], *second)
        miss = miss[self.keys[at[miss]] != keys[miss]]
        at[miss] = np.searchsorted(self.keys, keys[miss])
        return self.values[at]

    def _place(self, keys: np.ndarray, factor: int, bits: int, places: np.ndarray) -> np.ndarray:
        return places[self._slot(keys, factor, bits)]


def _runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and end of the runs of rows that are equal in all columns."""
    n = len(columns[0])
    change = np.zeros(max(n - 1, 0), bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    edges = [0, *(np.flatnonzero(change) + 1).tolist(), n]
    return zip(edges[:-1], edges[1:])


def _ask(block: int, kind: int, keys: np.ndarray, n: np.ndarray, buckets: int) -> dict:
    """Rows by bucket of the keys of a block."""
    of = (mix(keys >> np.uint64(8 * (DEPTH - SPLIT + 1)) if kind == STRINGS else keys) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    keys, n, of = keys[order], n[order], of[order]
    cuts = list(_runs(of)) if len(of) else []
    return {"block": [block] * len(cuts), "kind": [kind] * len(cuts), "bucket": [int(of[a]) + buckets * kind for a, _ in cuts],
            "keys": [pack_keys(keys[a:b]) for a, b in cuts], "n": [pack(n[a:b]) for a, b in cuts]}


def _read(rows: DataFrame, buckets: int, block_bytes: int) -> DataFrame:
    """The texts with their blocks (kind TEXT, rows in ``keys``), and what each block asks for (kinds STRINGS and WORDS)."""
    schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, tallies = TaskContext.get().partitionId() << 32, 0, _tallies()

        def asked() -> Iterator[pa.RecordBatch]:
            for which, tally in zip((STRINGS, WORDS), tallies):
                yield pa.RecordBatch.from_pydict(_ask(block, which, *tally.result(), buckets), schema)

        for part in texts(batches, step=STEP):
            train = part.rows.column(2).to_numpy(zero_copy_only=False).astype(np.uint64)
            for keys, row in strings(part):
                tallies[STRINGS].see(keys, train[row])
            tokens, row = words(part)
            tallies[WORDS].see(tokens, train[row])
            yield pa.RecordBatch.from_pydict({"block": [block], "kind": [TEXT], "bucket": [None], "keys": [pack_rows(part.rows.select(["id", "text"]))], "n": [None]}, schema)
            held += len(part.data) + len(part)
            if held >= block_bytes:
                yield from asked()
                block, held, tallies = block + 1, 0, _tallies()
                give_back()
        if held:
            yield from asked()

    return rows.select("id", "text", "train").mapInArrow(tidied(run), "block long, kind int, bucket int, keys binary, n binary")


def _grown(asked: DataFrame, tasks: int) -> DataFrame:
    """A row of keys and counts per bucket; for strings also rows of the nodes with SPLIT bytes, for words their numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kind, tally = None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            if now is None:
                return
            keys, n = tally.result()
            yield pa.RecordBatch.from_pydict(
                {"bucket": [now], "kind": [kind], "keys": [pack_keys(keys)], "n": [pack(n)], "total": [int(n.sum())], "known": [int((n > 0).sum())]} | dict.fromkeys(["context", "place", "zeros", "ones", "whole"], [None]), schema)
            if kind == STRINGS:
                context, place, zeros, ones, whole = Tree(keys, n).tops()
                m = len(context)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, now, np.int32)), pa.array(np.full(m, kind, np.int32)), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()),
                     pa.array(context.astype(np.int64)), pa.array(place.astype(np.int64)), pa.array(zeros), pa.array(ones), pa.array(whole)], schema=schema)

        schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("n", pa.binary()), ("total", pa.int64()), ("known", pa.int64()),
                            ("context", pa.int64()), ("place", pa.int64()), ("zeros", pa.int64()), ("ones", pa.int64()), ("whole", pa.float64())])
        for b in batches:
            for row in range(b.num_rows):
                bucket = b.column(0)[row].as_py()
                if bucket != now:
                    yield from done()
                    now, kind, tally = bucket, b.column(1)[row].as_py(), Tally()
                tally.add(unpack_keys(b.column(2)[row].as_py()), unpack(b.column(3)[row].as_py()))
        yield from done()

    return asked.select("bucket", "kind", "keys", "n").repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(
        tidied(run), "bucket int, kind int, keys binary, n binary, total long, known long, context long, place long, zeros long, ones long, whole double")


def _above(tops: DataFrame) -> DataFrame:
    """(bucket, name, sum, rest) per node with SPLIT bytes: the probability of a one that the nodes above give it, and its rest."""
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            zeros, ones = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            own = log_kt(zeros, ones)
            whole = np.logaddexp(own, b.column(4).to_numpy(zero_copy_only=False)) - _LN2
            stop = np.exp(np.minimum(own - _LN2 - whole, 0))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(whole), pa.array(stop)], names=["context", "place", "zeros", "ones", "whole", "stop"])

    levels = [tops]
    for _ in range(SPLIT):
        up = levels[-1].groupBy(F.shiftright("context", 8).alias("context"), "place").agg(
            F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("whole").alias("below"))
        levels.append(stored(up.mapInArrow(tidied(weigh), "context long, place long, zeros long, ones long, whole double, stop double"), "nodes"))
    estimate = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1.0)
    above = None
    for level in reversed(levels):
        if above is None:
            above = stored(level.select("context", "place", (F.col("stop") * estimate).alias("sum"), (1 - F.col("stop")).alias("rest")), "down")
        else:
            parent = above.select(F.col("context").alias("up"), F.col("place").alias("same"), "sum", "rest")
            here = level.join(parent, (F.shiftright(level["context"], 8) == F.col("up")) & (level["place"] == F.col("same")))
            if level is tops:
                return here.select("bucket", F.shiftleft("context", 8).bitwiseOR(F.col("place")).alias("name"), "sum", "rest")
            last, above = above, stored(here.select(
                "context", "place", (F.col("sum") + F.col("rest") * F.col("stop") * estimate).alias("sum"), (F.col("rest") * (1 - F.col("stop"))).alias("rest")), "down")
            discard(last)
        discard(level)
    return above


def _answered(trees: DataFrame, above: DataFrame, asked: DataFrame, tasks: int) -> DataFrame:
    """(block, kind, keys, values): costs of the strings, counts of the words that each block asked for."""
    def none(kind: str, *names: str) -> list:
        return [F.lit(None).cast(kind).alias(x) for x in names]

    rows = trees.select("bucket", F.lit(0).alias("turn"), *none("long", "block"), "kind", "keys", "n", *none("long", "name"), *none("double", "sum", "rest"))
    rows = rows.unionByName(above.select("bucket", F.lit(1).alias("turn"), *none("long", "block"), *none("int", "kind"), *none("binary", "keys", "n"), "name", "sum", "rest"))
    rows = rows.unionByName(asked.select("bucket", F.lit(2).alias("turn"), "block", "kind", "keys", *none("binary", "n"), *none("long", "name"), *none("double", "sum", "rest")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, n, above, values = None, None, None, [], None
        for b in batches:
            bucket, turn = (b.column(i).to_numpy() for i in (0, 1))
            for first, end in _runs(bucket, turn):
                if bucket[first] != now:
                    now, above, values = bucket[first], [], None
                part = b.slice(first, end - first)
                if turn[first] == 0:
                    keys, n = unpack_keys(part.column(4)[0].as_py()), unpack(part.column(5)[0].as_py())
                elif turn[first] == 1:
                    above.append([part.column(i).to_numpy() for i in (6, 7, 8)])
                else:
                    kind = part.column(3)[0].as_py()
                    if values is None:
                        if kind == STRINGS:
                            name, total, rest = (np.concatenate(x) for x in zip(*above))
                            values = Tree(keys, n).costs(name.astype(np.uint64), total, rest)
                        else:
                            values = n
                    raw = [x.as_py() for x in part.column(4)]
                    found = [pack(values[np.searchsorted(keys, unpack_keys(x))], "<f4" if kind == STRINGS else "<u8") for x in raw]
                    yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), part.column(4), pa.array(found, pa.binary())], names=["block", "kind", "keys", "values"])

    return rows.repartition(tasks, "bucket").sortWithinPartitions("bucket", "turn").mapInArrow(tidied(run), "block long, kind int, keys binary, values binary")


def scored(docs: DataFrame, id_column: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) per row of ``docs``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(crc_fold(id_column, FOLDS) != HELD, F.lit(False)).alias("train"), F.coalesce(text, F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    buckets, blocks = max(1, -(-size // bucket_bytes)), max(1, -(-size // block_bytes))
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    # small partitions are read as one, so that blocks fill up
    partitions = min(rows.rdd.getNumPartitions(), max(blocks, spark.sparkContext.defaultParallelism))
    table = stored(_read(rows.coalesce(max(1, partitions)), buckets, block_bytes), "read")
    asked = table.filter(F.col("kind") != TEXT).select("block", "kind", "bucket", "keys", "n")
    grown = stored(_grown(asked, min(2 * buckets, most)), "trees")
    total = grown.filter(F.col("kind") == WORDS).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("known"), F.lit(0)).alias("v")).first()
    bottom = total["n"] + 0.1 * (total["v"] + 1)
    above = _above(grown.filter(F.col("context").isNotNull()).select("bucket", "context", "place", "zeros", "ones", "whole"))
    answered = stored(_answered(grown.filter(F.col("context").isNull()).select("bucket", "kind", "keys", "n"), above, asked, min(2 * buckets, most)), "costs")
    discard(grown)
    meeting = answered.unionByName(table.filter(F.col("kind") == TEXT).select("block", "kind", "keys", F.lit(None).cast("binary").alias("values")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lists, costs, counts = None, None, None, None
        for b in batches:
            block, turn = (b.column(i).to_numpy() for i in (0, 1))
            for first, end in _runs(block, turn):
                if block[first] != now:
                    now, lists, costs, counts = block[first], ([], []), None, None
                rows = b.slice(first, end - first)
                if turn[first] != TEXT:
                    lists[turn[first]].extend((unpack_keys(k.as_py()), unpack(v.as_py(), "<f4" if turn[first] == STRINGS else "<u8")) for k, v in zip(rows.column(2), rows.column(3)))
                    continue
                if costs is None:
                    costs, counts = Lookup(lists[STRINGS]), Lookup(lists[WORDS])
                    give_back()
                for part in texts(batch for raw in rows.column(2) for batch in pa.ipc.open_stream(raw.as_py())):
                    sums = np.zeros(len(part))
                    for keys, row in strings(part):
                        sums += np.bincount(row, weights=costs(keys), minlength=len(part))
                    tokens, row = words(part)
                    c = counts(tokens)
                    base = np.bincount(row, weights=np.log10((c + 0.1) / bottom), minlength=len(part))
                    yield pa.RecordBatch.from_arrays(
                        [part.rows.column(0), pa.array(np.bincount(row, minlength=len(part))), pa.array(np.bincount(row[c > 0], minlength=len(part))), pa.array(base), pa.array(sums), pa.array(np.diff(part.offs))],
                        names=["id", "n_tokens", "n_known", "base_score", "score", "bytes"])

    tasks = max(1, min(most, blocks + partitions))
    out = meeting.repartition(tasks, "block").sortWithinPartitions("block", "kind").mapInArrow(
        tidied(score), f"id {kind}, n_tokens long, n_known long, base_score double, score double, bytes long")
    return out.select(
        F.col("id").alias(id_column), (crc_fold("id", FOLDS) == HELD).alias("held_out"), "n_tokens", "n_known", F.lit(total["n"]).cast("long").alias("train_tokens"),
        "base_score", "score", (-F.col("score") / F.log10(F.lit(2.0)) / (F.col("bytes") + 1)).alias("bits_per_byte"))
