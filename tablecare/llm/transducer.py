"""Pieces of texts by a weighted finite-state transducer, and texts from pieces.

The transducer is compiled from a model file and is the composition of four:

- the normaliser: a space becomes the space sign, and a text gets one in front;
- the lexicon: from any place in the text, an arc for each piece that stands there;
- byte fallback: an arc for a character that is no piece, which writes its bytes; it costs more than any piece;
- the pair acceptor, whose states are pieces: it lets piece v follow u only if joining the best pairs of the characters of
  u and v, one pair after the other as the model's scores say, gives u and v again. Other pairs cost infinity.

Composed with a text, the tropical shortest path gives the pieces. For a model of scored pairs exactly one path is finite,
and it is what joining pairs over the whole text gives. Two neighbouring characters that no piece holds next to each other
are never joined, so a text is cut there and each part is a composition of its own; workers remember the parts' paths.

Null and empty texts have no pieces. Rows are encoded each for itself. Extra columns are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.llm.text import bounded_batches

SPACE = "▁"
FALLBACK = 1000.0
#: Parts, and pairs, that a worker remembers; what it forgets is worked out again.
REMEMBERED = 500_000
TEXT_STEP = 1 << 20

_PARTS = re.compile(f"{SPACE}+[^{SPACE}]*")
_compiled: dict[str, Transducer] = {}


class Transducer:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.bytes_of = [b""] * size  # what a piece writes when texts are made from pieces
        for piece, i in self.ids.items():
            self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])
        self.neighbours = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.begun = {p[:k]: p[:k] in self.ids for p in self.ids for k in range(2, len(p) + 1)}  # what pieces begin with: is it one?
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}

    def joined(self, text: str) -> list[str]:
        """The characters of a short text joined by the best pair, the leftmost of equals, until none is a piece."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, u: str, v: str) -> bool:
        """Does the pair acceptor let v follow u?"""
        key = u, v
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > REMEMBERED:
                self.pairs.clear()
            found = self.pairs[key] = self.joined(u + v) == [u, v]
        return found

    def shortest(self, text: str) -> list[str]:
        """The pieces, and single characters that are none, on the shortest path through the composition with ``text``."""
        n, ids, begun, pairs = len(text), self.ids, self.begun, self.pairs
        cost, arc = [0.0] + [float("inf")] * n, [""] * (n + 1)
        for i in range(n):  # all arcs into a place come before those out of it
            so_far, last = cost[i], arc[i]
            if i and not last:
                continue  # no path leads here
            for j in range(i + 1, n + 1):
                piece = text[i:j]
                if j - i == 1:
                    step = so_far + (1.0 if piece in ids else FALLBACK)
                elif (whole := begun.get(piece)) is None:
                    break  # no piece goes on like this
                elif whole:
                    step = so_far + 1.0
                else:
                    continue
                if step < cost[j]:
                    if i:
                        may = pairs.get((last, piece))
                        if not (self.follows(last, piece) if may is None else may):
                            continue
                    cost[j], arc[j] = step, piece
        out = []
        while n:
            out.append(arc[n])
            n -= len(arc[n])
        return out[::-1]

    def part(self, text: str) -> bytes:
        """Ids of a part, as little-endian unsigned 32-bit integers."""
        out, first, units, neighbours = [], 0, self.units, self.neighbours
        for k in range(1, len(text) + 1):
            if k == len(text) or text[k - 1 : k + 1] not in neighbours:
                unit = text[first:k]
                first = k
                found = units.get(unit)
                if found is None:
                    ids = [i for p in self.shortest(unit) for i in ((self.ids[p],) if p in self.ids else map(self.byte_ids.__getitem__, p.encode()))]
                    found = units[unit] = struct.pack(f"<{len(ids)}I", *ids)
                out.append(found)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of texts: each distinct part is looked up once, its ids are copied to all its places."""
        parts = [_PARTS.findall(SPACE + text.replace(" ", SPACE)) if text else [] for text in texts]
        known = self.known
        for new in {x for some in parts for x in some}.difference(known):
            known[new] = self.part(new)
        out = [b"".join(map(known.__getitem__, some)) for some in parts]
        if len(known) > REMEMBERED:
            known.clear()
        if len(self.units) > REMEMBERED:
            self.units.clear()
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no text become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")[1:]


def compiled(path: str) -> Transducer:
    """The worker's transducer of this model file."""
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def _batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Rows in steps of about TEXT_STEP bytes."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * TEXT_STEP / max(batch.column(column).nbytes, 1)))
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def encoded(docs: DataFrame, model: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids) per row of ``docs``."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches, 1):
            raw = compiled(model).encode_all(batch.column(1).to_pylist())
            offs = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offs), pa.array(np.frombuffer(b"".join(raw), "<i4")))], names=[id_column, "ids"])

    return docs.select(id_column, F.coalesce(text, F.lit("")).alias("text")).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def decoded(rows: DataFrame, model: str, id_column: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id, text) per row of ``rows``; null ids are as none."""
    bounded_batches(rows.sparkSession)
    kind = rows.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([compiled(model).decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=[id_column, "text"])

    return rows.select(id_column, ids).mapInArrow(run, f"`{id_column}` {kind}, text string")


def round_trip(docs: DataFrame, model: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_crc32, same: is the text made from the pieces the text itself) per row of ``docs``."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches, 1):
            words = batch.column(1).to_pylist()
            raw = compiled(model).encode_all(words)
            same = [compiled(model).decode(np.frombuffer(r, "<u4").tolist()) == x for r, x in zip(raw, words)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(same, pa.bool_())],
                names=[id_column, "n_tokens", "ids_crc32", "same"])

    return docs.select(id_column, F.coalesce(text, F.lit("")).alias("text")).mapInArrow(run, f"`{id_column}` {kind}, n_tokens long, ids_crc32 long, same boolean")
