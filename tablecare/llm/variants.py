"""Spelling variants: words one letter apart, by PartEnum signatures of their letters.

A word's letters are a multiset, which is a set of (letter, which occurrence); one inserted or deleted letter changes it in one
element and a replaced one in two, so near words are sets of Hamming distance two at most. PartEnum deals the elements to PARTS
parts by a hash and enumerates all ways of leaving two parts out: sets that differ in at most two elements agree on the rest in at
least one of the ways, so near words have a signature (way, hash of what is left) in common. A signature also carries one half
of the word, as an edit leaves the letters before or after it as they are; the half's length is that of the shorter word of the pair. An
equi-join brings words of one signature together and the edit distance decides.

A signature of more than GROUP words is not compared pair by pair: its words are dealt on by the word with one place left out (and
where), which for words one letter apart is equal, so that all pairs found are near. No partner is lost and no group is
emitted as all its pairs. A word has no more near words than alphabet and length allow.

Null and empty texts have no words; a row without an id counts as one with an empty id. Rows count one by one, equal ones too. Very long
texts are worked on alone and need some 12 bytes a byte. Of words of equal n the first in code-point order is the form. An empty
table gives an empty table. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablecare.llm.links import discard, stored
from tablecare.llm.text import Texts, bounded_batches, map_texts, mix, runs

FOLDS = 31
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form is at least this many times as frequent as its variant.
TIMES = 10
PARTS, LEFT_OUT = 4, 2
#: Words of one signature that are compared pair by pair.
GROUP = 128
_STEP = 8 << 20

_CRC = np.array([zlib.crc32(bytes([i]), 0xFFFFFFFF) ^ 0xFFFFFFFF for i in range(256)], np.uint32)


def _letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to A-Z, a-z or U+00C0 to U+00FF."""
    low = data | 0x20
    mask = (low >= 0x61) & (low <= 0x7A)
    if len(data) > 1:
        first = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0xBF))
        mask[first] = mask[first + 1] = True
    return mask


def _crc(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each span, going on from ``before``, byte by byte over all spans at once."""
    state = ~before
    order = np.argsort(starts - ends, kind="stable")
    lens = (ends - starts)[order]
    at, state = starts[order], state[order]
    for i in range(int(lens[0]) if len(lens) else 0):
        left = int(np.searchsorted(-lens, -i, side="left"))  # spans longer than i
        one = state[:left]
        state[:left] = _CRC[(one ^ data[at[:left] + i]) & np.uint32(0xFF)] ^ (one >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = state
    return ~out


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray, width: np.ndarray) -> pa.Array:
    """The spans as texts, ``width`` bytes from ``gone`` on left out."""
    lens = ends - starts
    offs = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
    values = data[np.repeat(starts - offs[:-1], lens) + np.arange(offs[-1])]
    cut = np.flatnonzero(width)
    if len(cut):
        keep = np.ones(len(values), bool)
        at = offs[cut] + gone[cut] - starts[cut]
        keep[at] = False
        keep[at[width[cut] == 2] + 1] = False
        values, offs = values[keep], np.concatenate([[0], np.cumsum(lens - width)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(lens), pa.py_buffer(offs), pa.py_buffer(values))


def _words(part: Texts) -> tuple[pa.Array, np.ndarray]:
    """The words of some rows after the deletions, and their lengths in code points."""
    low = part.lower()
    data = low.data
    starts, ends = runs(_letters(data), low.offs)
    rows = low.row_of(starts)
    ids = part.rows.column(0).to_pylist()
    head = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    h = _crc(data, starts, ends, head[rows]).astype(np.int64)
    second = np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80)])  # bytes that go on a code point
    length = ends - starts - (second[ends] - second[starts])
    gone, width = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    hit = np.flatnonzero(h % FOLDS == 0)
    place = h[hit] % length[hit]
    plain = length[hit] == ends[hit] - starts[hit]
    gone[hit[plain]] = starts[hit[plain]] + place[plain]
    for k, p in zip(hit[~plain].tolist(), place[~plain].tolist()):
        firsts = np.flatnonzero((data[starts[k] : ends[k]] & 0xC0) != 0x80)
        gone[k] = starts[k] + firsts[p]
    width[hit] = 1 + (data[gone[hit]] == 0xC3) if len(hit) else 0
    length[hit] -= 1
    long = length >= LEAST_LENGTH
    return _gather(data, starts[long], ends[long], gone[long], width[long]), length[long]


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of all words of LEAST_LENGTH code points or more, found LEAST_COUNT times or more."""
    def count(part: Texts) -> pa.RecordBatch:
        words = pc.value_counts(_words(part)[0])
        return pa.RecordBatch.from_arrays([words.field("values").cast(pa.string()), words.field("counts")], names=["word", "n"])

    counted = map_texts(docs.select("doc_id", F.col(text).alias("text")), count, "word string, n long", step=_STEP)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _hash(codes: list[int], seed: int) -> int:
    """64 bits of a short list of numbers."""
    out = seed
    for c in codes:
        out = (out ^ c) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        out ^= out >> 29
    return out


#: The ways of leaving parts out.
WAYS = list(combinations(range(PARTS), LEFT_OUT))


def signatures(word: str) -> list[int]:
    """64-bit signatures; two words one letter apart have one in common."""
    seen: dict[str, int] = {}
    parts = [0] * PARTS
    for letter in word:
        nth = seen[letter] = seen.get(letter, 0) + 1
        element = _hash([ord(letter), nth], 7)
        parts[element % PARTS] += element >> 3  # a sum: letters come in any order
    total = sum(parts)
    left = [total - sum(parts[i] for i in way) for way in WAYS]
    out = []
    for shorter in (len(word), len(word) - 1):  # of a pair this word may be the longer one
        half = shorter // 2
        for side, letters in enumerate((word[:half], word[-half:])):
            own = _hash([ord(c) for c in letters], shorter * 2 + side + 1)
            out += [_hash([k, s & 0xFFFFFFFFFFFFFFFF], own) for k, s in enumerate(left)]
    return out


def _signed(words: DataFrame) -> DataFrame:
    """(signature, word): one row per signature of each word."""
    def sign(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                names = batch.column(0).slice(at, 4096)
                keys = [signatures(w) for w in names.to_pylist()]
                many = np.array([len(k) for k in keys])
                flat = mix(np.array([x for k in keys for x in k], np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), names.take(pa.array(np.repeat(np.arange(len(names)), many)))], names=["signature", "word"])

    bounded_batches(words.sparkSession)
    return words.select("word").mapInArrow(sign, "signature long, word string")


def _left_out(word: F.Column) -> F.Column:
    """(where, rest) for each place of the word that is left out, and (0, word) for a longer word's rest to meet."""
    n = F.char_length(word)
    rests = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        i.alias("place"), F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)).alias("rest")))
    # in a run of equal letters each place leaves the same rest
    return F.concat(rests, F.transform(F.array_distinct(rests["rest"]), lambda r: F.struct(F.lit(0).alias("place"), r.alias("rest"))),
                    F.array(F.struct(F.lit(-1).alias("place"), word.alias("rest"))))


def near_pairs(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(a, b), a < b, of all words of ``words`` (word) that differ by one inserted, deleted or replaced letter."""
    alike = Window.partitionBy("signature")
    signed = stored(_signed(words).withColumn("size", F.count("*").over(alike)).filter("size > 1"), "signatures")
    small = signed.filter(F.col("size") <= group)
    close = (F.col("a") < F.col("b")) & (F.abs(F.char_length("a") - F.char_length("b")) <= 1)
    direct = small.select("signature", F.col("word").alias("a")).join(small.select("signature", F.col("word").alias("b")), "signature").filter(
        close & (F.levenshtein("a", "b", 1) == 1)).select("a", "b").distinct()
    # words of large groups, once each: the place left out makes every pair a near one
    large = signed.filter(F.col("size") > group).select("word").distinct()
    spread = stored(large.select("word", F.explode(_left_out(F.col("word"))).alias("v")).select("word", "v.place", "v.rest"), "left-out")
    a, b = (spread.select(F.col("word").alias(n), "place", "rest") for n in "ab")
    replaced = a.filter("place > 0").join(b.filter("place > 0"), ["place", "rest"]).filter("a < b").select("a", "b")
    inserted = a.filter("place = 0").join(b.filter("place = -1"), "rest").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = stored(direct.unionByName(replaced).unionByName(inserted).distinct(), "near-words")
    discard(signed, spread)
    return pairs


def _forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(word, n, form, n_near, form_n) of each word."""
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    with_n = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = with_n.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    rows = words.join(best, "word", "left")
    often = -F.col("best.less") >= TIMES * F.col("n")
    return rows.select("word", "n", F.when(often, F.col("best.near")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                       F.when(often, -F.col("best.less")).alias("form_n"))


def variants(docs: DataFrame, text: str = "text", group: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word."""
    words = stored(word_counts(docs, text), "words")
    pairs = near_pairs(words, group)
    formed = stored(_forms(words, pairs), "word-forms")
    discard(words, pairs)
    # each step multiplies n by TIMES or more, so chains are short
    form = formed.filter("form is not null").select(F.col("word").alias("root"), F.col("form").alias("next"))
    roots = stored(form.select(F.col("root").alias("word"), F.col("next").alias("root")), "roots")
    while not roots.join(form, "root", "left_semi").isEmpty():
        further = stored(roots.join(form, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        discard(roots)
        roots = further
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
