"""Lines that many documents repeat, as bitmaps of the lines that go.

Main path: DataFrame functions only. A line's key is its text without white space at the ends and with A-Z lower-cased; keys
of at least 20 code points are hashed to 128 bits, so that no text is shuffled to find repeats. Hashes are dealt by range
and sorted by document (the largest first) and position; one pass over a range sees the document that keeps the line first and
streams on. Keys that could fill a range (more than one row in 1,024, found by a mergeable sketch of frequent items, so 1,024
of them at most) are counted with map-side combine instead, and their verdicts are broadcast. What comes back is, per document,
a sparse bitmap: 64 lines a word, words without a dropped line left out.

Every row stands for itself in the result. Rows with the same id are one document, whatever their texts; rows without an id
are together one document that counts as smaller than any other. Null and empty texts have one empty line. Of equal lines
in the keeping document all stay. Very long texts are split inside one row, so they have to fit a task; their lines are dealt out
one by one. An empty table gives an empty table. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecare.llm.links import discard, stored

#: What counts as white space at the ends of a line.
SPACE = " \t\n\x0b\x0c\r"
LEAST_LENGTH = 20
LEAST_DOCUMENTS = 3
#: A key with more than one row in HOT is counted apart.
HOT = 1024


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case; other letters stay."""
    bare = F.btrim(line, F.lit(SPACE))
    plain = F.octet_length(bare) == F.char_length(bare)  # ASCII only: the fast function says the same
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _rows(docs: DataFrame, text: str) -> DataFrame:
    """(id, tag, text): tag is a digest of the text, so that rows which share an id are told apart."""
    return docs.select(F.col("doc_id").alias("id"), F.xxhash64(F.col(text)).alias("tag"), F.col(text).alias("text"))


def keyed_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(k1, k2, id, tag, pos) of every line whose key is long enough."""
    lines = _rows(docs, text).select("id", "tag", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("id", "tag", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= LEAST_LENGTH)
    return keyed.select(F.xxhash64(F.lit(1), "key").alias("k1"), F.xxhash64(F.lit(2), "key").alias("k2"), "id", "tag", "pos")


def _frequent(lines: DataFrame) -> DataFrame:
    """(k1) of the keys that may hold more than one row in HOT; none that does is missed, and there are HOT at most."""
    many = lines.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(k1, {HOT}, {16 * HOT})").alias("top"))
    hot = many.select("n", F.explode("top").alias("top")).filter(F.col("top.count") * HOT > F.col("n"))
    return hot.select(F.col("top.item").alias("k1"))


def _dropped_streaming(lines: DataFrame) -> DataFrame:
    """(id, tag, pos) of lines that go, by one pass over ranges of hashes sorted by document and position.

    The first document keeps the line; a later one loses it if there is a third (LEAST_DOCUMENTS).
    """
    key = Window.partitionBy("k1", "k2")
    falling = key.orderBy(F.desc_nulls_last("id"), "pos")
    whole = falling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = lines.repartitionByRange("k1", "k2").select(
        "id", "tag", "pos", F.last("id").over(whole).alias("least"), F.dense_rank().over(key.orderBy(F.desc_nulls_last("id"))).alias("nth"))
    # a third document comes after this one, or this is the third
    return seen.filter((F.col("nth") > 1) & (~F.col("id").eqNullSafe(F.col("least")) | (F.col("nth") >= LEAST_DOCUMENTS))).select("id", "tag", "pos")


def _dropped_counted(lines: DataFrame) -> DataFrame:
    """The same for the few frequent keys, by combined counts."""
    documents = lines.groupBy("k1", "k2", "id").agg(F.lit(1).alias("one"))
    verdict = documents.groupBy("k1", "k2").agg(F.max("id").alias("keeper"), F.count("*").alias("n")).filter(F.col("n") >= LEAST_DOCUMENTS)
    return lines.join(F.broadcast(verdict), ["k1", "k2"]).filter(~F.col("id").eqNullSafe(F.col("keeper"))).select("id", "tag", "pos")


def drop_bitmaps(docs: DataFrame, text: str = "text") -> DataFrame:
    """(id, tag, words) of each document that loses lines: ``words`` are (at, bits) by ``at``; bit i of a word is line 64 * at + i.

    ``tag`` is the xxhash64 of the text. A document that is not there, and a line without a bit, stays as it is.
    """
    lines = stored(keyed_lines(docs, text), "lines")
    hot = stored(_frequent(lines), "hot-lines")
    light = lines.join(F.broadcast(hot), "k1", "left_anti")
    heavy = lines.join(F.broadcast(hot), "k1")
    gone = _dropped_streaming(light).unionByName(_dropped_counted(heavy))
    words = gone.groupBy("id", "tag", F.expr("pos div 64").cast("int").alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    found = stored(words.groupBy("id", "tag").agg(F.sort_array(F.collect_list(F.struct("at", "bits"))).alias("words")), "line-bitmaps")
    discard(lines, hot)
    return found


def _dense(words: Column) -> Column:
    """The words one after the other, those left out as 0."""
    def with_gap(word: Column, i: Column) -> Column:
        before = F.coalesce(F.get(words, i - 1)["at"], F.lit(-1))
        return F.concat(F.array_repeat(F.lit(0).cast("long"), word["at"] - before - 1), F.array(word["bits"]))

    return F.flatten(F.transform(words, with_gap))


def without_repeated_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) of every row: ``kept`` are the lines that stay, joined by line breaks."""
    found = drop_bitmaps(docs, text)
    words = found.select("id", "tag", _dense(F.col("words")).alias("bits"), F.expr("aggregate(words, 0, (n, w) -> n + bit_count(w.bits))").alias("n_dropped"))
    rows = _rows(docs, text).alias("r")
    same = F.col("r.id").eqNullSafe(F.col("w.id")) & (F.col("r.tag") == F.col("w.tag"))
    joined = rows.join(words.alias("w").hint("shuffle_hash"), same, "left").select(
        F.col("r.id").alias("doc_id"), F.coalesce("r.text", F.lit("")).alias("text"), "bits", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"))

    def stays(_line: Column, i: Column) -> Column:
        word = F.coalesce(F.get("bits", F.floor(i / 64).cast("int")), F.lit(0).cast("long"))
        return F.getbit(word, i % 64) == 0

    kept = F.when(F.col("bits").isNull(), F.col("text")).otherwise(F.array_join(F.filter(_lines(F.col("text")), stays), "\n"))
    return joined.select("doc_id", F.size(_lines(F.col("text"))).cast("long").alias("n_lines"), "n_dropped", kept.alias("kept"))


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) per row."""
    return without_repeated_lines(docs, text).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


_SPACES = " || ".join(f"chr({ord(c)})" for c in SPACE)
_KEY = f"translate(trim(line, {_SPACES}), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
ORACLE_SQL = f"""WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
    lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM split),
    keyed AS (SELECT *, {_KEY} AS key FROM lines),
    many AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= {LEAST_LENGTH} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCUMENTS}),
    judged AS (SELECT k.*, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM keyed k LEFT JOIN many USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM judged GROUP BY doc_id"""
