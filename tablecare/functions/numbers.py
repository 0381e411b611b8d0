"""Column helpers for numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain or scientific decimal number, white space allowed around it.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def looks_number(c: Column) -> Column:
    return c.rlike(NUMBER_PATTERN)


def parse_number(c: Column) -> Column:
    """Text to double; null where the text is not a number.

    The pattern keeps out Java forms such as ``12d`` that a cast accepts.
    """
    return F.when(looks_number(c), c.try_cast("double"))


def nan_to_null(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def finite(c: Column) -> Column:
    """A double without NaN and infinities, which statistics leave out."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & ~d.isin(float("inf"), float("-inf")), d)
