"""Texts of Arrow batches as flat byte arrays: words, word hashes and windows over them, without a loop over rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecare.scratch import ship_package

#: Bytes of text that one step of a task works on; a longer text is a step of its own.
STEP_BYTES = 2 << 20
#: Bytes that Spark hands to a task at once.
BATCH_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def bounded_batches(spark: SparkSession) -> None:
    """Bound what Spark hands to a Python task at once by bytes, since rows can be long; and let tasks find this package."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1))) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Texts:
    """Some rows of a batch: ``data`` holds their bytes one after the other, row i at ``offs[i]:offs[i + 1]``."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, offs: np.ndarray):
        self.rows, self.data, self.offs = rows, data, offs

    def __len__(self) -> int:
        return len(self.offs) - 1

    def lower(self) -> Texts:
        """A-Z as a-z; other letters stay."""
        return Texts(self.rows, _LOWER[self.data], self.offs)

    def taken(self, rows: np.ndarray) -> Texts:
        """Some of the rows, ascending."""
        if len(rows) == len(self):
            return self
        n = np.diff(self.offs)[rows]
        offs = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        data = np.concatenate([self.data[self.offs[r] : self.offs[r + 1]] for r in rows]) if len(rows) else self.data[:0]
        return Texts(self.rows.take(pa.array(rows)), data, offs)

    def row_of(self, at: np.ndarray) -> np.ndarray:
        """The row of each byte position."""
        return np.searchsorted(self.offs, at, side="right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, end and row of each word ``[^\\x20\\x09-\\x0D]+``; a word never spans rows."""
        starts, ends = runs(~_SPACE[self.data], self.offs)
        return starts, ends, self.row_of(starts)


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true; rows end at ``offs``."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    begins = mask.copy()
    begins[1:] &= ~mask[:-1] | edge[1:n]
    ends = mask.copy()
    ends[:-1] &= ~mask[1:] | edge[1:n]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64 bits that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1024) - 1, _BASE)]), dtype=np.uint64)
    return _POWERS[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the spans, which don't overlap and come in order; none is empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    firsts = np.cumsum(lens) - lens
    within = np.arange(lens.sum()) - np.repeat(firsts, lens)
    values = data[np.repeat(starts, lens) + within].astype(np.uint64) + np.uint64(1)
    return mix(np.add.reduceat(values * powers(int(lens.max()))[within], firsts) + lens.astype(np.uint64))


def window_hashes(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words; a row with fewer words has its whole sequence as one window, an empty row none.

    Returns the hashes, the index of each window's first word, and the number of windows of each row.
    """
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    firsts = np.cumsum(counts) - counts
    at = np.repeat(firsts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    last = np.repeat(firsts + counts, n)
    total = np.zeros(len(at), np.uint64)
    for i in range(size):
        there = at + i < last
        total[there] = (total[there] + mix(hashes[at[there] + i] + np.uint64(i))) * _BASE
    return mix(total), at, n


def give_back() -> None:
    """Hand memory that is free back to the system: workers live on into other tasks, beside those that work then."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # what glibc has for it
    if trim:
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a task's work for mapInArrow, which hands its memory back at its end."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return work


def texts(batches: Iterator[pa.RecordBatch], column: str = "text", step: int = STEP_BYTES) -> Iterator[Texts]:
    """The batches in steps of about ``step`` bytes of ``column``; null is as empty."""
    for batch in batches:
        array = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        if array.null_count:
            array = array.fill_null(b"")
        if not len(array):
            continue
        offs = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
        data = np.frombuffer(array.buffers()[2] or b"", np.uint8)
        first = 0
        while first < len(array):
            last = max(first + 1, int(np.searchsorted(offs, offs[first] + step, side="right")) - 1)
            yield Texts(batch.slice(first, last - first), data[offs[first] : offs[last]], offs[first : last + 1] - offs[first])
            first = last


def map_texts(docs: DataFrame, work: Callable[[Texts], pa.RecordBatch | None], schema: str, column: str = "text", step: int = STEP_BYTES) -> DataFrame:
    """``work`` on all rows of ``docs``, step by step."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in texts(batches, column, step):
            out = work(part)
            if out is not None and out.num_rows:
                yield out

    return docs.mapInArrow(tidied(run), schema)


def packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """``values`` cut into one binary per row, ``counts`` values each."""
    width = values.dtype.itemsize
    offs = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * width
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def unpacked(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column without nulls, and the number in each row."""
    array = column.cast(pa.large_binary())
    offs = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    width = np.dtype(dtype).itemsize
    raw = np.frombuffer(array.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
    return raw.view(dtype) if len(raw) % width == 0 and raw.ctypes.data % width == 0 else np.frombuffer(raw.tobytes(), dtype), np.diff(offs) // width


def crc_fold(doc_id: str, folds: int) -> F.Column:
    """crc32 of the decimal text of an id, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(folds)
