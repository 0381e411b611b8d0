"""Token ids in files of directly addressable codes.

A file holds the ids of consecutive documents. An id is cut into chunks of 8 bits, the lowest first. Level 1 has the first
chunk of every id, and a bit for each that says whether the id goes on; level 2 has the next chunk of those that do, and
so on. A directory of the set bits before each block of 512 leads from an id's place on one level to its place on the
next, so any token is read without decoding others.

File: ``DAC1``, levels L, documents D, ids N (unsigned 64-bit), then for each level its number of chunks; D + 1 places
where documents start; for each level the chunks, padded to 8 bytes, the bits, packed in bytes and padded, and the
directory (unsigned 64-bit). All integers are little-endian.

Documents are dealt to tasks by ranges of their ids and sorted there; each task writes its files under a name of its own
and moves them into place whole, so a task that runs again replaces what it wrote with the same bytes. Null and empty
texts have the end id alone. Rows that share an id are ordered by text. Null ids come first. Extra columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.llm.text import bounded_batches, tidied
from tablecare.llm.tokens import encoder
from tablecare.scratch import new_path

BLOCK = 512
#: Ids of a file; a file ends with the document that reaches it.
FILE_IDS = 1 << 21
#: Characters of text that are encoded at a time.
TEXT_STEP = 1 << 20


def _padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 8)


def encode(ids: np.ndarray, starts: np.ndarray) -> bytes:
    """The bytes of a file of ``ids`` (unsigned 32-bit) whose documents begin at ``starts``; the last start is the number of ids."""
    levels, rest = [], ids.astype("<u4")
    while len(rest) or not levels:
        high = rest >> 8
        more = high > 0
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint64) if len(more) else np.zeros(0, np.uint64)
        before = np.concatenate([[0], np.cumsum(ones)[:-1]]) if len(ones) else ones
        levels.append(((rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), before.astype("<u8").tobytes()))
        rest = high[more]
    head = np.array([len(levels), len(starts) - 1, len(ids), *(len(x[0]) for x in levels)], "<u8").tobytes()
    return b"".join([b"DAC1\0\0\0\0", head, starts.astype("<u8").tobytes(), *(_padded(x) for level in levels for x in level)])


class Codes:
    """Reads a file; ``raw`` is its bytes or a map of them."""

    def __init__(self, raw: bytes):
        if bytes(raw[:4]) != b"DAC1":
            raise ValueError("not a file of directly addressable codes")
        count, docs, self.n = (int(x) for x in np.frombuffer(raw, "<u8", 3, 8))
        sizes = np.frombuffer(raw, "<u8", count, 32).astype(np.int64)
        at = 32 + 8 * count
        self.starts = np.frombuffer(raw, "<u8", docs + 1, at).astype(np.int64)
        at += 8 * (docs + 1)
        self.levels = []
        for n in sizes.tolist():
            parts = []
            for dtype, size in ((np.uint8, n), (np.uint8, (n + 7) // 8), ("<u8", (n + BLOCK - 1) // BLOCK)):
                parts.append(np.frombuffer(raw, dtype, size, at))
                width = parts[-1].nbytes
                at += width + -width % 8
            self.levels.append(parts)

    def _rank(self, level: int, place: int) -> int:
        """Set bits of a level before ``place``."""
        _, bits, before = self.levels[level]
        block = place // BLOCK
        if block == len(before):
            block -= 1
        inside = np.unpackbits(bits[block * BLOCK // 8 : (place + 7) // 8], bitorder="little")[: place - block * BLOCK]
        return int(before[block]) + int(inside.sum()) if len(before) else 0

    def __getitem__(self, place: int) -> int:
        """One token, whatever comes before it."""
        if not 0 <= place < self.n:
            raise IndexError(place)
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[place]) << (8 * level)
            if not bits[place // 8] >> (place % 8) & 1:
                return value
            place = self._rank(level, place)
        return value

    def slice(self, first: int, last: int) -> np.ndarray:
        """Ids ``first`` to ``last``, without those before them."""
        out = np.zeros(last - first, np.uint32)
        where = np.arange(last - first)
        for level, (chunks, bits, _) in enumerate(self.levels):
            if first >= last:
                break
            out[where] |= chunks[first:last].astype(np.uint32) << np.uint32(8 * level)
            more = np.unpackbits(bits[first // 8 : (last + 7) // 8], bitorder="little")[first % 8 : first % 8 + last - first].astype(bool)
            where = where[more]
            first = self._rank(level, first)
            last = first + len(where)
        return out


def _put(uri: str, raw: bytes) -> None:
    """Write a file under another name and move it into place."""
    store, path = fs.FileSystem.from_uri(uri)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(raw)
    store.move(part, path)


def _get(uri: str) -> bytes:
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as file:
        return file.read()


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, id_column: str = "doc_id", text: str = "text", end: int = 0) -> DataFrame:
    """Write the ids of all texts, each with ``end`` after it, to files under ``folder`` in order of ``id_column``.

    Returns a row per file: part and file (their order is that of the documents), n_ids, uri and the documents' ids.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    uri = folder if "://" in folder else f"file://{folder}" if folder.startswith("/") else folder.replace("file:/", "file:///", 1)
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path)
    kind = docs.schema[id_column].dataType.simpleString()
    parts = max(docs.rdd.getNumPartitions(), 1)
    ordered = docs.select(F.col(id_column).alias("id"), F.coalesce(text, F.lit("")).alias("text")).repartitionByRange(
        parts, F.col("id").asc_nulls_first(), "text").sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    last = np.array([end], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, file, names, raw = TaskContext.get().partitionId(), 0, [], []

        def flush() -> pa.RecordBatch:
            nonlocal file, names, raw
            ids = np.frombuffer(b"".join(raw), "<u4")
            at = f"{uri}/part-{part:06d}-{file:04d}.dac"
            _put(at, encode(ids, np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])])))
            row = pa.RecordBatch.from_pydict({"part": [part], "file": [file], "n_ids": [len(ids)], "uri": [at], "ids": [names]},
                                             pa.schema([("part", pa.int32()), ("file", pa.int32()), ("n_ids", pa.int64()), ("uri", pa.string()), ("ids", pa.list_(id_type))]))
            file, names, raw = file + 1, [], []
            return row

        held = 0
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            values, words = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            first = 0
            while first < len(words):
                stop, size = first, 0
                while stop < len(words) and (stop == first or size + len(words[stop]) <= TEXT_STEP):
                    size += len(words[stop])
                    stop += 1
                found = encoder(tokenizer).encode(words[first:stop])
                names += values[first:stop]
                raw += [x + last for x in found]
                held += sum(map(len, found)) // 4 + len(found)
                first = stop
                if held >= FILE_IDS:
                    yield flush()
                    held = 0
        if names:
            yield flush()

    return ordered.mapInArrow(tidied(write), f"part int, file int, n_ids long, uri string, ids array<{kind}>")


def token_rows(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text", end: int = 0, folder: str | None = None) -> DataFrame:
    """Write the token files and read them back: (id, start, n_tokens, ids_crc32) per row of ``docs``."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    kind = docs.schema[id_column].dataType.simpleString()
    listed = new_path(spark, "files")
    write_tokens(docs, folder, tokenizer, id_column, text, end).write.parquet(listed)
    files = spark.read.parquet(listed)
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").toArrow()  # a row per task
    before = np.concatenate([[0], np.cumsum(sizes.column("n").to_numpy())]).astype(np.int64)
    offsets = spark.createDataFrame(
        [(int(p), int(b)) for p, b in zip(sizes.column("part").to_pylist(), before)], "part int, base long")
    from pyspark.sql import Window

    earlier = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = files.join(offsets, "part").withColumn("start", F.col("base") + earlier).select("uri", "start", "ids")
    placed = placed.repartition(max(len(sizes), 1), "uri")  # files are few rows, but much work

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes = Codes(_get(batch.column(0)[i].as_py()))
                places = codes.starts
                crcs = [zlib.crc32(codes.slice(a, b).astype("<u4").tobytes()) for a, b in zip(places[:-1].tolist(), places[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2)[i].values, pa.array(places[:-1] + batch.column(1)[i].as_py()), pa.array(np.diff(places)), pa.array(crcs, pa.int64())],
                    names=["id", "start", "n_tokens", "ids_crc32"])

    found = placed.mapInArrow(tidied(read), f"id {kind}, start long, n_tokens long, ids_crc32 long")
    return found.withColumnRenamed("id", id_column)
