"""Quality rules whose thresholds come from the corpus: mergeable quantile sketches per language and source.

Of every text four measures are taken: characters per word, symbols per word, and the shares of repeated lines and of words
in repeated windows. A sketch of a measure counts values by buckets whose bounds grow by 2 percent, so quantiles are within
1 percent of a value, sketches of parts of the data merge by adding counts, and the result is the same in any order. There
are sketches for each language and source, and merged ones for each language and for all. A text fails a measure that lies
far outside the quartiles of its language and source (of its language, or of all, where there are too few texts to tell):
beyond the quartile by WIDE times the distance from the median to it, and by a least distance that is the measure's own.
Most texts repeat nothing, so the quartiles of repeats are often zero; their upper thresholds also keep TAIL times the
distance from the quartile to the ninth decile. Of repeats, texts that fail the base tell nothing about their group.

Null and empty texts have zero words and fail the base. A null language or source is a group like others. Rows are judged
each for itself. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablecare.llm.links import stored
from tablecare.llm.text import _SPACE, Texts, map_texts, runs, span_hashes, window_hashes

WINDOW = 5
GROWTH = 1.02
WIDE = 6.0
TAIL = 2.0
#: Texts a group needs for thresholds of its own.
ENOUGH = 200
#: Measures, with the least distance above and below the quartiles; none below means no lower threshold.
MEASURES = {"word_length": (2.0, 1.0), "symbols": (0.25, None), "dup_lines": (0.15, None), "repeats": (0.05, None)}
REPEATS = ("dup_lines", "repeats")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(x) for x in "#*$%&|<>"]] = True


def counts(part: Texts) -> tuple[np.ndarray, ...]:
    """Of each row: words, their code points, symbols, repeated lines, words in repeated windows, lines."""
    n, data = len(part), part.data
    starts, ends, rows = part.words()
    words = np.bincount(rows, minlength=n)
    of = np.repeat(np.arange(n), np.diff(part.offs))
    chars = np.bincount(of[~_SPACE[data] & ((data & 0xC0) != 0x80)], minlength=n)
    symbols = np.bincount(of[_SYMBOL[data]], minlength=n)

    begin, end = runs(data != 10, part.offs)
    solid = np.concatenate([[0], np.cumsum(~_SPACE[data])])
    some = solid[end] > solid[begin]
    begin, end = begin[some], end[some]
    line_row, hashed = part.row_of(begin), span_hashes(data, begin, end)
    lines = np.bincount(line_row, minlength=n)
    order = np.lexsort((hashed, line_row))
    same = np.zeros(len(order), bool)
    same[1:] = (hashed[order][1:] == hashed[order][:-1]) & (line_row[order][1:] == line_row[order][:-1])
    dup_lines = np.bincount(line_row[order][same], minlength=n)

    windows, first, many = window_hashes(span_hashes(data, starts, ends), words, WINDOW)
    row = np.repeat(np.arange(n), many)
    order = np.lexsort((windows, row))
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = (windows[order][1:] == windows[order][:-1]) & (row[order][1:] == row[order][:-1])
    again = first[order[same[:-1] | same[1:]]] if len(order) else first
    cover = np.zeros(len(rows) + WINDOW + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    repeats = np.bincount(rows[np.cumsum(cover)[: len(rows)] > 0], minlength=n)
    return words, chars, symbols, dup_lines, repeats, lines


def bucket(x: np.ndarray) -> np.ndarray:
    """The bucket of each value, 0 for zero; values under 1/1000 count as zero."""
    return np.where(x < 1e-3, 0, 1 + np.ceil(np.log(np.maximum(x, 1e-3) / 1e-3) / np.log(GROWTH))).astype(np.int32)


def value(column: F.Column) -> F.Column:
    """The middle of a bucket."""
    return F.when(column == 0, 0.0).otherwise(1e-3 * F.pow(F.lit(GROWTH), column - 1.5))


def measured(docs: DataFrame, id_column: str, text: str, lang: str, source: str) -> DataFrame:
    fields = ", ".join(f"{name} {docs.schema[c].dataType.simpleString()}" for name, c in (("id", id_column), ("lang", lang), ("source", source)))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def work(part: Texts) -> pa.RecordBatch:
        words, chars, symbols, dup, repeats, lines = counts(part)
        some = np.maximum(words, 1)
        rates = [chars / some, symbols / some, dup / np.maximum(lines, 1), repeats / some]
        return pa.RecordBatch.from_arrays(
            [*part.rows.columns[:3], *(pa.array(x.astype(np.int64)) for x in (words, chars, symbols, dup, repeats)), *map(pa.array, rates), *(pa.array(bucket(x)) for x in rates)],
            names=["id", "lang", "source", *names, *MEASURES, *(f"{m}_at" for m in MEASURES)])

    rows = docs.select(F.col(id_column).alias("id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    return map_texts(rows, work, ", ".join([fields, *(f"{x} long" for x in names), *(f"{m} double" for m in MEASURES), *(f"{m}_at int" for m in MEASURES)]))


def base_failed() -> F.Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def thresholds(rows: DataFrame) -> DataFrame:
    """(lang, source, low and high of each measure) of every language and source among ``rows`` of measured()."""
    stack = ", ".join(f"'{m}', {m}_at" for m in MEASURES)
    sketch = rows.filter("n_words > 0").select("lang", "source", base_failed().alias("out"), F.expr(f"stack({len(MEASURES)}, {stack}) as (measure, at)"))
    sketch = sketch.filter(~F.col("out") | ~F.col("measure").isin(*REPEATS)).groupBy("lang", "source", "measure", "at").agg(F.count("*").alias("n"))
    sketch = stored(sketch, "sketches")  # buckets, not rows
    levels = sketch.withColumn("level", F.lit(0)).unionByName(
        sketch.groupBy("lang", "measure", "at").agg(F.sum("n").alias("n")).withColumns({"level": F.lit(1), "source": F.lit(None).cast("string")})).unionByName(
        sketch.groupBy("measure", "at").agg(F.sum("n").alias("n")).withColumns({"level": F.lit(2), "source": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")}))
    group = ["level", "lang", "source", "measure"]
    up_to = levels.withColumn("upto", F.sum("n").over(Window.partitionBy(*group).orderBy("at"))).withColumn("all", F.sum("n").over(Window.partitionBy(*group)))
    quartile = [F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("at"))).alias(f"q{i}") for i, q in enumerate((0.25, 0.5, 0.75, 0.9))]
    found = up_to.groupBy(*group).agg(F.max("all").alias("all"), *quartile)
    cut = []
    for m, (above, below) in MEASURES.items():
        q = [F.max(F.when(F.col("measure") == m, value(F.col(f"q{i}")))) for i in range(4)]
        wide = WIDE * (q[2] - q[1])
        cut.append((q[2] + (F.greatest(wide, TAIL * (q[3] - q[2])) if m in REPEATS else wide) + above).alias(f"{m}_high"))
        cut.append((F.lit(float("-inf")) if below is None else q[0] - WIDE * (q[1] - q[0]) - below).alias(f"{m}_low"))
    found = found.groupBy("level", "lang", "source").agg(F.when(F.count("*") == len(MEASURES), F.min("all")).alias("all"), *cut)
    ends = [f"{m}_{e}" for m in MEASURES for e in ("high", "low")]

    def at(level: int) -> DataFrame:
        own = found.filter((F.col("level") == level) & (F.lit(level == 2) | (F.col("all") >= ENOUGH)))
        return own.select(F.col("lang").alias(f"lang{level}"), F.col("source").alias(f"source{level}"), F.struct(*ends).alias(f"t{level}"))

    pairs = found.filter("level = 0").select("lang", "source")
    picked = pairs.join(at(0), F.col("lang").eqNullSafe(F.col("lang0")) & F.col("source").eqNullSafe(F.col("source0")), "left").join(
        at(1), F.col("lang").eqNullSafe(F.col("lang1")), "left").join(at(2).withColumn("one", F.lit(1)), F.lit(1) == F.col("one"), "left")
    return picked.select("lang", "source", F.coalesce("t0", "t1", "t2").alias("t")).select("lang", "source", "t.*")


def judge(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(id, counts, base_failed, kept, failed: the measures that lie outside) per row of ``docs``."""
    rows = stored(measured(docs, id_column, text, lang, source), "measures")
    cut = thresholds(rows).withColumnsRenamed({"lang": "cut_lang", "source": "cut_source"})
    both = rows.join(cut, F.col("lang").eqNullSafe(F.col("cut_lang")) & F.col("source").eqNullSafe(F.col("cut_source")), "left")
    outside = F.array_compact(F.array(*(F.when((F.col(m) > F.col(f"{m}_high")) | (F.col(m) < F.col(f"{m}_low")), F.lit(m)) for m in MEASURES)))
    failed = base_failed()
    return both.select(F.col("id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       failed.alias("base_failed"), (~failed & (F.size(outside) == 0)).alias("kept"), outside.alias("failed"))
