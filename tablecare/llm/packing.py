"""Packing of documents into sequences of a fixed number of tokens, by fitted patterns of few lengths.

Only the histogram of piece lengths, which has one count for each length up to that of a sequence, decides. Patterns of
one, two or three lengths that fill a sequence exactly are enumerated; non-negative least squares says how often each is
repeated so that the lengths used come to the histogram; the repeats are rounded to what is there; what is left over is
packed length by length, longest first, into the fullest sequences that have room. The plan is a list of ranges: of each
length, the pieces of rank a to b go to these sequences at this place. A piece finds its rank from its place among the
pieces of its length in its task and the counts of the tasks before, so no length is gathered in one task.

Null and empty texts are a piece that holds the end id alone. Rows that repeat an id are packed each for itself, and a
null id stays null. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablecare.llm.links import stored
from tablecare.llm.text import bounded_batches, tidied
from tablecare.llm.tokens import STEMS, encoder, forget

SEQUENCE = 2048
#: Rounds of the least-squares fit.
ROUNDS = 200
#: Repeats under which a pattern is left to the packing of the rest.
LEAST_REPEATS = 0.5
TEXT_STEP = 1 << 20


def pieces(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text", size: int = SEQUENCE, end: int = 0, remembered: int = STEMS) -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, nth) of each piece; nth counts the pieces of this length in the task."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    last = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            words = batch.column(1).to_pylist()
            first = 0
            while first < len(words):
                stop, held = first, 0
                while stop < len(words) and (stop == first or held + len(words[stop]) <= TEXT_STEP):
                    held += len(words[stop])
                    stop += 1
                raw = [x + last for x in encoder(tokenizer, remembered).encode(words[first:stop])]
                n = np.array([len(x) // 4 for x in raw])
                many = -(-n // size)
                row = np.repeat(np.arange(len(raw)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * size
                length = np.minimum(size, n[row] - start)
                crcs = [zlib.crc32(raw[r][4 * a : 4 * (a + b)]) for r, a, b in zip(row.tolist(), start.tolist(), length.tolist())]
                order = np.argsort(length, kind="stable")
                run = np.concatenate([[0], np.flatnonzero(np.diff(length[order])) + 1])
                inside = np.arange(len(row)) - np.repeat(run, np.diff(np.concatenate([run, [len(row)]])))
                nth = np.empty(len(row), np.int64)
                nth[order] = seen[length[order]] + inside
                seen += np.bincount(length, minlength=size + 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row + first)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                     pa.array(crcs, pa.int64()), pa.array(np.full(len(row), part, np.int32)), pa.array(nth)],
                    names=["id", "piece", "start", "length", "ids_crc32", "part", "nth"])
                first = stop

    return docs.select(F.col(id_column).alias("id"), F.coalesce(text, F.lit("")).alias("text")).mapInArrow(
        tidied(cut), f"id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """All ways to fill a sequence with up to three of ``lengths``: three columns, longest first, 0 for none."""
    there = np.zeros(size + 1, bool)
    there[lengths] = True
    found = [np.array([[size, 0, 0]])] if there[size] else []
    ordered = np.sort(lengths)[::-1]
    rest = size - ordered
    two = ordered[(rest > 0) & (rest <= ordered) & there[np.maximum(rest, 0)]]
    found.append(np.stack([two, size - two, np.zeros_like(two)], 1))
    for a in ordered[(ordered < size) & (3 * ordered >= size)].tolist():
        b = ordered[(ordered <= a) & (ordered < size - a) & (2 * ordered >= size - a)]
        d = size - a - b
        ok = there[d]
        found.append(np.stack([np.full(ok.sum(), a), b[ok], d[ok]], 1))
    return np.concatenate(found).astype(np.int64)


def fit(ways: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Repeats of the patterns, none negative, whose lengths come nearest to the histogram in squares."""
    def used(x: np.ndarray) -> np.ndarray:
        total = sum(np.bincount(ways[:, i], weights=x, minlength=len(counts)) for i in range(3))
        total[0] = 0
        return total

    if not len(ways):
        return np.zeros(0)
    target = counts.astype(float)
    target[0] = 0
    ones = used(np.ones(len(ways)))
    ones[0] = 0
    step = 1 / np.maximum(sum(ones[ways[:, i]] for i in range(3)), 1)
    x = look = np.zeros(len(ways))
    pace = 1.0
    for _ in range(ROUNDS):
        off = used(look) - target
        nxt = np.maximum(0, look - step * sum(off[ways[:, i]] for i in range(3)))
        quicker = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        look = nxt + (pace - 1) / quicker * (nxt - x)
        x, pace = nxt, quicker
    return x


def plan(counts: np.ndarray, size: int = SEQUENCE) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repeats, [(length, times)]) of each kind of sequence, so that every piece of the histogram has a place."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    made: list[tuple[int, list[tuple[int, int]]]] = []
    ways = patterns(np.flatnonzero(left), size)
    wanted = fit(ways, left)
    for k in np.argsort(-wanted, kind="stable").tolist():
        if wanted[k] < LEAST_REPEATS:
            break
        lengths, times = np.unique(ways[k][ways[k] > 0], return_counts=True)
        repeats = int(min(round(wanted[k]), (left[lengths] // times).min()))
        if repeats:
            left[lengths] -= repeats * times
            made.append((repeats, list(zip(lengths.tolist(), times.tolist()))))
    # the rest: by length, the longest first, into the sequences with the least room that is enough
    room: list[list[tuple[int, list[tuple[int, int]]]]] = [[] for _ in range(size + 1)]
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        space = length
        while n and space <= size:
            if not room[space]:
                space += 1
                continue
            many, held = room[space].pop()
            take = min(many, n)
            if many > take:
                room[space].append((many - take, held))
            room[space - length].append((take, [*held, (length, 1)]))
            n -= take
            if space - length >= length:  # what was just filled has the least room now
                space = space - length
        each = size // length
        if n >= each:
            room[size - each * length].append((n // each, [(length, each)]))
        if n % each:
            room[size - n % each * length].append((1, [(length, n % each)]))
    return made + [group for groups in room for group in groups]


def ranges(made: list[tuple[int, list[tuple[int, int]]]], size: int = SEQUENCE) -> dict[str, np.ndarray]:
    """The plan by length and rank: from which rank on, how many in a sequence, the first sequence and the place."""
    taken, rows, sequence = np.zeros(size + 1, np.int64), [], 0
    for repeats, held in made:
        place = 0
        for length, times in held:
            rows.append((length, taken[length], times, sequence, place))
            taken[length] += repeats * times
            place += length * times
        sequence += repeats
    table = np.array(rows, np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return dict(zip(("length", "rank", "times", "sequence", "place"), table.T))


def pack(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text", size: int = SEQUENCE, end: int = 0, remembered: int = STEMS) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row; ``remembered`` words stay in a worker's memory."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer, id_column, text, size, end, remembered), "pieces")
    held = stored(cut.groupBy("length", "part").agg(F.count("*").alias("many")), "held")
    rows = held.groupBy("length").agg(F.sum("many").alias("many")).toArrow()
    counts = np.zeros(size + 1, np.int64)
    counts[rows.column("length").to_numpy()] = rows.column("many").to_numpy()
    shared = spark.sparkContext.broadcast(ranges(plan(counts, size), size))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = cut.join(held.withColumn("base", F.coalesce(F.sum("many").over(before), F.lit(0))), ["length", "part"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        to = shared.value
        first = np.searchsorted(to["length"], np.arange(size + 2))
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                own = length == n
                at[own] = first[n] + np.searchsorted(to["rank"][first[n] : first[n + 1]], rank[own], side="right") - 1
            inside = rank - to["rank"][at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(to["sequence"][at] + inside // to["times"][at]), pa.array(to["place"][at] + inside % to["times"][at] * length)],
                names=[id_column, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema[id_column].dataType.simpleString()
    return ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank")).mapInArrow(
        tidied(place), f"`{id_column}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
