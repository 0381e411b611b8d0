"""Jobs over a catalog of tables: ``(table, pos, column)`` rows.

Snake-case names for all columns of a data lake, and the business domain of
each table told from its column names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.functions.lexicon import DOMAIN_TERMS
from tablecare.functions.text import snake
from tablecare.operators.joins import small_side

# Hits, or share of columns, that make a guess certain or likely.
HIGH_SCORE, HIGH_SHARE = 4, 0.4
MEDIUM_SCORE, MEDIUM_SHARE = 2, 0.2
GUESSES = 2


def _numbered(name: Column, nth: Column) -> Column:
    return F.when(nth == 1, name).otherwise(F.concat(name, F.lit("_"), nth.cast("string")))


def snake_names(catalog: DataFrame) -> DataFrame:
    """``(table, pos, column, new_name)`` with names unique within a table.

    The second and third column of one snake name get ``_2`` and ``_3``. If
    that name is taken as well, the numbering is repeated on the new names.
    """
    named = catalog.select("table", "pos", "column", snake(F.col("column")).alias("new_name"))
    while True:
        w = Window.partitionBy("table", "new_name").orderBy("pos")
        named = named.withColumn("new_name", _numbered(F.col("new_name"), F.row_number().over(w)))
        clash = named.groupBy("table", "new_name").count().where("count > 1")
        if clash.isEmpty():
            return named


def unique_snake_names(spark: SparkSession, columns: list[str]) -> list[str]:
    """The snake-case names of one table's columns, in their order."""
    if not columns:
        return []
    rows = [("t", i, c) for i, c in enumerate(columns)]
    catalog = spark.createDataFrame(rows, "table string, pos int, column string")
    return [r["new_name"] for r in snake_names(catalog).orderBy("pos").collect()]


def catalog_of(tables: dict[str, DataFrame]) -> DataFrame:
    """The ``(table, pos, column)`` rows of some DataFrames."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, i, c) for t, df in tables.items() for i, c in enumerate(df.columns)]
    return spark.createDataFrame(rows, "table string, pos int, column string")


def default_lexicon(spark: SparkSession) -> DataFrame:
    """The built-in ``(domain, domain_pos, term)`` rows."""
    rows = [(d, i, t) for i, (d, terms) in enumerate(DOMAIN_TERMS.items()) for t in terms]
    schema = T.StructType([T.StructField("domain", T.StringType()), T.StructField("domain_pos", T.IntegerType()),
                           T.StructField("term", T.StringType())])
    return spark.createDataFrame(rows, schema)


def plain_name(c: Column) -> Column:
    """Lower case, with underscores, hyphens and blanks as single blanks."""
    return F.trim(F.regexp_replace(F.lower(c), r"[_\-\s]+", " "))


def _phrases(name: Column, longest: int) -> Column:
    """All runs of one to *longest* words of a name that stand side by side."""
    pieces = F.split(name, r"[^\p{L}\p{N} ]+")
    words = F.transform(pieces, lambda p: F.filter(F.split(p, " "), lambda w: w != ""))

    def runs(ws: Column) -> Column:
        n = F.size(ws)
        lengths = F.sequence(F.lit(1), F.lit(longest))
        return F.flatten(F.transform(lengths, lambda k: F.transform(
            F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i + k - 1 <= n),
            lambda i: F.array_join(F.slice(ws, i, k), " "),
        )))

    return F.array_distinct(F.flatten(F.transform(words, runs)))


def confidence(score: Column, columns: Column) -> Column:
    share = score / F.greatest(columns, F.lit(1))
    return (
        F.when(columns == 0, F.lit("low"))
        .when((score >= HIGH_SCORE) | (share >= HIGH_SHARE), F.lit("high"))
        .when((score >= MEDIUM_SCORE) | (share >= MEDIUM_SHARE), F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def tag_domains(catalog: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """``(table, rank, domain, score, confidence)``: the two likeliest domains.

    The score is the number of distinct terms of a domain that occur as whole
    words in any column name. Names are split into words and runs of words, so
    that terms are found by an equi-join.
    """
    lexicon = lexicon if lexicon is not None else default_lexicon(catalog.sparkSession)
    terms = (
        lexicon.groupBy("domain", plain_name(F.col("term")).alias("term"))
        .agg(F.min("domain_pos").alias("domain_pos"))
    )
    longest = terms.agg(F.max(F.size(F.split("term", " ")))).first()[0] or 1
    hits = (
        catalog.select("table", F.explode(_phrases(plain_name(F.col("column")), longest)).alias("term"))
        .distinct()
        .join(small_side(terms), "term")
    )
    scores = hits.groupBy("table", "domain").agg(
        F.count("*").alias("score"), F.min("domain_pos").alias("domain_pos")
    )
    widths = catalog.groupBy("table").agg(F.count("*").alias("columns"))
    w = Window.partitionBy("table").orderBy(F.desc("score"), "domain_pos")
    return (
        scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= GUESSES)
        .join(widths, "table")
        .select("table", "rank", "domain", "score", confidence(F.col("score"), F.col("columns")).alias("confidence"))
    )
