"""Value histograms: how often each distinct value of each column occurs.

Columns of one type are turned into narrow ``(pos, value)`` rows and counted
with map-side combine, so a hot value leaves each task as a single row. The
result answers distinct counts, top values, parse shares and label spellings
at once; texts are judged once per distinct value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecare.functions.dates import DEFAULT_FORMATS, parse_timestamp
from tablecare.functions.numbers import looks_number
from tablecare.functions.text import strip
from tablecare.operators.schema import column

# Longer texts are shuffled as a digest. The digest form is 65 bytes long, so it
# can never be mistaken for a text that is kept as it is.
LONG_TEXT_BYTES = 64


def text_key(c: Column) -> Column:
    """The text itself, or ``#`` and its SHA-256 when it is long."""
    return F.when(F.octet_length(c) <= LONG_TEXT_BYTES, c).otherwise(
        F.concat(F.lit("#"), F.sha2(c, 256))
    )


def tall(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Non-null values of same-typed columns as ``(pos, value)`` rows."""
    wide = df.select(*[c.alias(pos) for pos, c in columns.items()])
    return wide.unpivot([], list(columns), "pos", "value").where(F.col("value").isNotNull())


def value_counts(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``(pos, value, n)`` for columns of one type."""
    return tall(df, columns).groupBy("pos", "value").agg(F.count("*").alias("n"))


def text_counts(df: DataFrame, columns: dict[str, Column], formats=DEFAULT_FORMATS) -> DataFrame:
    """``(pos, value, n, chars, is_number, ts, padded)`` per distinct text.

    ``value`` is the :func:`text_key`. What has to be known about a long text is
    found before the shuffle and carried along as plain numbers.
    """
    value, is_long = F.col("value"), F.octet_length("value") > LONG_TEXT_BYTES

    def facts(c: Column) -> dict[str, Column]:
        return {
            "chars": F.length(c),
            "is_number": looks_number(c).cast("int"),
            "ts": parse_timestamp(c, formats),
            "padded": (c != strip(c)).cast("int"),
        }

    counted = (
        tall(df, columns)
        .select("pos", text_key(value).alias("value"),
                *[F.when(is_long, f).alias(k) for k, f in facts(value).items()])
        .groupBy("pos", "value")
        .agg(F.count("*").alias("n"), *[F.max(k).alias(k) for k in facts(value)])
    )
    # a long text is one whose length came along
    return counted.select(
        "pos", "value", "n",
        *[F.when(F.col("chars").isNull(), f).otherwise(F.col(k)).alias(k)
          for k, f in facts(value).items()],
    )


def top_values(counts: DataFrame, k: int) -> DataFrame:
    """The *k* most frequent values per column, ties by value.

    Spark cuts each task's rows to *k* per column before it shuffles them.
    """
    w = Window.partitionBy("pos").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def column_value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, value, n)`` over the text form of the columns, values whole."""
    names = columns or df.columns
    by_pos = {str(i): column(n).cast("string") for i, n in enumerate(names)}
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("pos").cast("int") + 1)
    return value_counts(df, by_pos).select(label.alias("column"), "value", "n")
