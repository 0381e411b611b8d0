"""Sample rows of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablecare.functions.numbers import finite
from tablecare.operators.schema import as_text, column, kinds

SAMPLE_ROWS = 5


def sample_rows(
    df: DataFrame, order_by: list[str] | None = None, k: int = SAMPLE_ROWS, seed: int = 0
) -> DataFrame:
    """First, last and random *k* rows as ``(section, rank, <columns>)``.

    Tables have no order of their own: first and last need *order_by*. The
    random rows are those with the smallest hash of seed and order columns
    (or of all columns), which every run finds again. Each part is a top-k,
    never a full sort. NaN and infinities become null.
    """
    clean = [
        finite(column(n)).cast(df.schema[n].dataType).alias(n) if kind == "fraction" else column(n)
        for n, kind in kinds(df).items()
    ]
    mixed = F.md5(F.concat_ws("|", F.lit(str(seed)), *[as_text(df, n) for n in order_by or df.columns]))
    orders = {"random": [mixed.asc()]}
    if order_by:
        orders["first"] = [column(n).asc() for n in order_by]
        orders["last"] = [column(n).desc() for n in order_by]

    def part(section: str) -> DataFrame:
        ranked = df.orderBy(*orders[section]).limit(k)
        w = Window.partitionBy(F.lit(section)).orderBy(*orders[section])
        return ranked.select(F.lit(section).alias("section"), F.row_number().over(w).alias("rank"), *clean)

    return reduce(DataFrame.unionByName, [part(s) for s in orders])
