"""Records of text files whose ends can only be told from the start of the file, read range by range.

Spark cuts a large text file into ranges and a piece (what ends with a separator) belongs to the range in which it starts. Where a
record ends depends on whether the range starts inside quotes and how deep inside brackets, which no range knows by itself.
But each piece is a transition: from quotes open or closed before it to quotes open or closed after it, with a change of depth for
either case. Transitions compose, so

1. a first pass composes those of each range to one row (ends, depths and the least depth for both cases);
2. a prefix over these rows, one per range, gives the true start of each range;
3. a second pass reads the ranges side by side and cuts them into records; the parts of a record that spans ranges are put
   together by the range it starts in.

No file has to be read by one task, and what is shuffled is one row a range and the parts at the cuts. Ranges are
those that Spark plans; should they differ between the passes, the job ends with an error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablecare.scratch import new_path, ship_package

#: Rows of ranges (one per range, some 80 bytes) that are broadcast at most; more are an error that asks for larger ranges.
MOST_RANGES = 2_000_000
_BATCH_BYTES = 16 << 20


@dataclass(frozen=True)
class Grammar:
    """How pieces change the state, as columns of the piece (a text column named ``piece``).

    closed, opened: are quotes open after the piece, if they were closed, open before it; up, up_opened: change of depth in these
    cases; nested: does the file's first piece make depth 1 the level of records; spans: would a reader of plain lines cut
    records elsewhere; ``terminated``: a record needs its last separator,
    which belongs to it.
    """

    separator: str
    closed: Column
    opened: Column
    up: Column
    up_opened: Column
    nested: Column
    spans: Column
    terminated: bool


def csv_grammar(sep: str) -> Grammar:
    """Lines; a quote opens a field at the field's first character only and closes it unless doubled."""
    other = f"[^{_in_class(sep)}]"
    inside = r'[^"]*+(?:""[^"]*+)*+'
    rest = f'(?:(?:"{inside}"{other}*+|[^"{_in_class(sep)}]{other}*+|){_literal(sep)})*+"{inside}\\z'
    piece, none = F.col("piece"), F.lit(0)
    closed = piece.rlike(f"\\A{rest}")
    return Grammar("\n", closed, piece.rlike(f'\\A{inside}(?:\\z|"{other}*+{_literal(sep)}{rest})'), none, none, F.lit(False), closed | piece.rlike(r"(?s)\r."), False)


def json_grammar() -> Grammar:
    """Pieces that end with ``}``: strings, escapes and brackets decide where an object of an array ends."""
    plain = F.regexp_replace("piece", r"(?s)\\.", "")
    strings = r'"[^"]*+(?:"|\z)'
    quotes = F.length(plain) - F.length(F.replace(plain, F.lit('"')))

    def depth(rest: Column, odd: Column) -> Column:
        left = F.regexp_replace(rest, strings, "")
        ups = F.length(left) * 2 - F.length(F.replace(left, F.lit("{"))) - F.length(F.replace(left, F.lit("[")))
        downs = F.length(left) * 2 - F.length(F.replace(left, F.lit("}"))) - F.length(F.replace(left, F.lit("]")))
        return (ups - downs - F.when(odd, 0).otherwise(1)).cast("int")  # the separator goes down outside of strings

    odd = quotes % 2 == 1
    return Grammar("}", odd, ~odd, depth(plain, odd), depth(F.regexp_replace(plain, r'\A[^"]*+(?:"|\z)', ""), ~odd),
                   F.col("piece").rlike(r"\A\s*\["), F.lit(True), True)


def _literal(char: str) -> str:
    return f"\\x{{{ord(char):x}}}"


_in_class = _literal


def _pieces(spark: SparkSession, paths: Sequence[str], grammar: Grammar) -> DataFrame:
    """(piece, at: its range (file, start, length), file_size)"""
    # as many ranges in each pass, whatever executors come and go meanwhile
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism)
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1))) > _BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_BATCH_BYTES))
    ship_package(spark)
    meta = [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
            F.col("_metadata.file_block_length").alias("length"), F.col("_metadata.file_size").alias("file_size")]
    return spark.read.option("lineSep", grammar.separator).text(list(paths)).select(F.col("value").alias("piece"), *meta)


def _codes(grammar: Grammar) -> list[Column]:
    return [grammar.closed.alias("closed"), grammar.opened.alias("opened"), grammar.up.cast("int").alias("up"), grammar.up_opened.cast("int").alias("up_opened")]


def _states(closed: np.ndarray, opened: np.ndarray, start: bool) -> np.ndarray:
    """Are quotes open after each piece? Pieces set, keep or turn the state; what counts is the last that sets it and the turns since."""
    at = np.arange(len(closed))
    turns = np.cumsum(closed & ~opened)
    last = np.maximum.accumulate(np.where(closed == opened, at, -1))
    there = last >= 0
    base = np.where(there, closed[np.maximum(last, 0)], start)
    since = turns - np.where(there, turns[np.maximum(last, 0)], 0)
    return base ^ (since % 2 == 1)


def _depths(after: np.ndarray, start: bool, depth: int, up: np.ndarray, up_opened: np.ndarray) -> np.ndarray:
    before = np.concatenate([[start], after[:-1]])
    return depth + np.cumsum(np.where(before, up_opened, up), dtype=np.int64)


def _same_range(batch: pa.RecordBatch, columns: Sequence[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of a batch that lie in one range, and which."""
    keys = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in columns]
    change = np.zeros(max(batch.num_rows - 1, 0), bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield tuple(k[a].item() for k in keys), batch.slice(a, b - a)


def _arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("closed", "opened", "up", "up_opened")]


_RANGE = ["file", "start", "length", "file_size"]
_NONE = 1 << 62


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per range: state and change of depth at its end, and the least depth outside quotes, for quotes closed and open before it."""
    held: dict[tuple, list] = {}

    def out() -> pa.RecordBatch:
        rows = [(*key, read, nested, spans, *(x for state in states for x in state)) for key, (read, nested, states, spans) in held.items()]
        names = [*_RANGE, "read", "nested", "spans", "end0", "depth0", "least0", "end1", "depth1", "least1"]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)

    for batch in batches:
        for key, part in _same_range(batch, _RANGE):
            if key not in held:
                if held:
                    yield out()
                    held.clear()
                held[key] = [0, part.column(part.schema.get_field_index("nested"))[0].as_py(), [(False, 0, _NONE), (True, 0, _NONE)], False]
            own = held[key]
            own[0] += pc.sum(part.column(part.schema.get_field_index("size"))).as_py()
            closed, opened, up, up_opened = _arrays(part)
            own[3] = own[3] or bool(pc.any(part.column(part.schema.get_field_index("spans"))).as_py())
            for h, (state, depth, least) in enumerate(own[2]):
                after = _states(closed, opened, state)
                depths = _depths(after, state, depth, up, up_opened)
                outside = depths[~after]
                own[2][h] = (bool(after[-1]), int(depths[-1]), min(least, int(outside.min())) if len(outside) else least)
    if held:
        yield out()


def starts(spark: SparkSession, paths: Sequence[str], grammar: Grammar) -> DataFrame:
    """The true start of each range: (id, file, start, length, opened_before, depth_before, origin, final, cut, spans and more).

    ``origin`` is the range in which the record that is unfinished at the start began, null if none is; ``depth_before`` counts from
    the level of records; ``cut``: the file's last piece lacks its separator; ``spans``: a reader of plain lines would
    cut records elsewhere, as a piece of the range opens quotes that it does not close, say.
    """
    pieces = _pieces(spark, paths, grammar)
    coded = pieces.select(*_RANGE, (F.octet_length("piece") + 1).cast("long").alias("size"), grammar.nested.alias("nested"), grammar.spans.alias("spans"), *_codes(grammar))
    schema = ("file long, start long, length long, file_size long, read long, nested boolean, spans boolean, end0 boolean, depth0 long, least0 long, end1 boolean, depth1 long, least1 long")
    path = new_path(spark, "ranges")
    coded.mapInArrow(_composed, schema).write.parquet(path)
    rows = spark.read.parquet(path)
    file = Window.partitionBy("file")
    earlier = file.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    upto = file.orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sets = F.col("end0") == F.col("end1")
    rows = rows.withColumn("turns", F.sum(F.when(F.col("end0") & ~F.col("end1"), 1).otherwise(0)).over(upto))
    rows = rows.withColumn("set", F.last(F.when(sets, F.struct("end0", "turns")), ignorenulls=True).over(earlier)).withColumn("turned", F.last("turns").over(earlier))
    opened = F.coalesce("set.end0", F.lit(False)) != ((F.coalesce("turned", F.lit(0)) - F.coalesce("set.turns", F.lit(0))) % 2 == 1)
    rows = rows.withColumn("opened_before", opened)
    level = F.first("nested").over(file.orderBy("start")).cast("long")
    moved = F.when(F.col("opened_before"), F.col("depth1")).otherwise(F.col("depth0"))
    rows = rows.withColumn("depth_before", F.coalesce(F.sum(moved).over(earlier), F.lit(0)) - level)
    inside = F.col("opened_before") | (F.col("depth_before") > 0)
    ends = F.col("depth_before") + F.when(F.col("opened_before"), F.col("least1")).otherwise(F.col("least0")) <= 0
    over = F.sum("read").over(file) - F.col("file_size")
    rows = rows.withColumns({"inside": inside, "through": inside & ~ends, "final": F.lead("start").over(file.orderBy("start")).isNull(),
                             # a byte-order mark is not in the first piece
                             "cut": F.lit(grammar.terminated) & ~over.isin(0, -3)}).withColumn("id", F.monotonically_increasing_id())
    # ids ascend within a file, as rows are sorted by start there; stored, so that they stay what they are
    path = new_path(spark, "range-starts")
    rows.select("id", *_RANGE, "opened_before", "depth_before", "inside", "through", "final", "cut", "spans").write.parquet(path)
    stored = spark.read.parquet(path)
    began = F.last(F.when(~F.col("through"), F.col("id")), ignorenulls=True).over(earlier)
    return stored.withColumn("origin", F.when(F.col("inside"), F.coalesce(began, F.col("id"))))


class _Cutter:
    """Cuts the pieces of one range into records."""

    def __init__(self, key: tuple, separator: bytes):
        self.id, self.opened, self.depth, self.origin, self.final, self.cut, self.first = key
        self.separator = separator
        self.pending: list[pa.Array] = []
        self.whole_head = self.origin is None  # does the record that is being read start in this range?
        self.held: pa.RecordBatch | None = None

    def _joined(self, pieces: pa.Array, offsets: np.ndarray) -> pa.Array:
        lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pieces)
        return pc.binary_join(lists, pa.scalar(self.separator, pa.large_binary()))

    def _row(self, records: pa.Array, origin: int | None, whole: bool) -> pa.RecordBatch:
        n = len(records)
        first = np.zeros(n, bool)
        if n and self.first:
            first[0], self.first = True, False
        return pa.RecordBatch.from_arrays(
            [records, pa.array([origin] * n, pa.int64()), pa.array(np.full(n, self.id)), pa.array(np.full(n, whole)), pa.array(first)],
            names=["record", "origin", "id", "whole", "first"])

    def add(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The records that end in these pieces; the last piece waits, as it may be the file's last."""
        if self.held is not None:
            part = pa.Table.from_batches([self.held, part]).combine_chunks().to_batches()[0]
        self.held = part.slice(part.num_rows - 1)
        if part.num_rows > 1:
            yield from self._cut(part.slice(0, part.num_rows - 1), False)

    def _cut(self, part: pa.RecordBatch, unended: bool) -> Iterator[pa.RecordBatch]:
        closed, opened, up, up_opened = _arrays(part)
        after = _states(closed, opened, self.opened)
        depths = _depths(after, self.opened, self.depth, up, up_opened)
        self.opened, self.depth = bool(after[-1]), int(depths[-1])
        ends = np.flatnonzero(~after & (depths <= 0))
        if unended:
            ends = ends[:0]
        pieces = part.column(part.schema.get_field_index("piece")).cast(pa.large_binary())
        if not len(ends):
            self.pending.append(pieces)
            return
        if self.pending:
            before = sum(map(len, self.pending))
            pieces = pa.concat_arrays([*self.pending, pieces])
            ends = ends + before
        # a copy, so that the batch can go
        self.pending = [pa.concat_arrays([pieces.slice(int(ends[-1]) + 1)])] if ends[-1] + 1 < len(pieces) else []
        records = self._joined(pieces.slice(0, int(ends[-1]) + 1), np.concatenate([[0], ends + 1]))
        if not self.whole_head:
            yield self._row(records.slice(0, 1), self.origin, True)
            self.whole_head = True
            records = records.slice(1)
        if len(records):
            yield self._row(records, None, True)

    def end(self) -> Iterator[pa.RecordBatch]:
        """What the range leaves: the last piece, and the part of a record that goes on or is never ended."""
        if self.held is not None:
            yield from self._cut(self.held, self.final and self.cut)
        if self.pending:
            pieces = pa.concat_arrays(self.pending)
            part = self._joined(pieces, np.array([0, len(pieces)]))
            origin = self.id if self.whole_head else self.origin
            yield self._row(part, origin, not self.final)


_KEY = ["id", "opened_before", "depth_before", "origin", "final", "cut", "file_start"]
_RECORD = "record binary, origin long, id long, whole boolean, first boolean"


def _cutting(separator: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter: _Cutter | None = None
        for batch in batches:
            for _, part in _same_range(batch, ["id"]):
                key = tuple(part.column(part.schema.get_field_index(c))[0].as_py() for c in _KEY)
                if cutter is None or cutter.id != key[0]:
                    if cutter is not None:
                        yield from map(_plain, cutter.end())
                    cutter = _Cutter(key, separator)
                yield from map(_plain, cutter.add(part.select(["piece", "closed", "opened", "up", "up_opened"])))
        if cutter is not None:
            yield from map(_plain, cutter.end())

    return run


def _plain(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.set_column(0, "record", batch.column(0).cast(pa.binary()))


def records(spark: SparkSession, paths: Sequence[str], grammar: Grammar, ranges: DataFrame) -> DataFrame:
    """(record binary, whole boolean, first boolean): the records of files; ``first``: that of its file; not ``whole``: the file ends within it."""
    pieces = _pieces(spark, paths, grammar)
    many = ranges.count()
    if many > MOST_RANGES:
        raise ValueError(f"{many} ranges of files: raise spark.sql.files.maxPartitionBytes")
    known = ranges.select("file", "start", "length", "id", "opened_before", "depth_before", "origin", "final", "cut", (F.col("start") == 0).alias("file_start"))
    lost = F.raise_error(F.lit("the ranges of a file changed between two passes")).cast("long")

    def cut(known: DataFrame, how: str) -> DataFrame:
        met = pieces.join(F.broadcast(known), ["file", "start", "length"], how)
        keyed = met.withColumn("id", F.coalesce("id", lost)) if how == "left" else met
        return keyed.select(F.col("piece").cast("binary").alias("piece"), *_KEY, *_codes(grammar)).mapInArrow(_cutting(grammar.separator.encode()), _RECORD)

    whole = cut(known, "left").filter("origin is null")
    # ranges with a part of a record that spans ranges, or of one that is never ended
    file = Window.partitionBy("file").orderBy("start")
    goes_on = F.coalesce(F.lead("inside").over(file), F.lit(True))
    some = ranges.withColumn("goes_on", goes_on).filter("inside or goes_on").select("id")
    parts = cut(known.join(some, "id", "left_semi"), "inner").filter("origin is not null")
    joined = parts.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("id", "record"))).alias("parts"), F.bool_and("whole").alias("whole"), F.max("first").alias("first"))
    text = F.array_join(F.transform("parts", lambda p: p["record"].cast("string")), grammar.separator)
    spanning = joined.select(text.cast("binary").alias("record"), "whole", "first")
    return whole.select("record", "whole", "first").unionByName(spanning)
