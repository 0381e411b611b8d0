"""Write cleaned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.operators.schema import column, kinds


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of CSV files with a header each and no index column.

    Nested columns are written as JSON, which CSV has no form for, binary ones
    in hex, and timestamps with their microseconds where there are any.
    """
    flat = [_flat(df, n, k).alias(n) for n, k in kinds(df).items()]
    (
        df.select(*flat).write.mode(mode).option("header", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def _flat(df: DataFrame, name: str, kind: str) -> Column:
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.BinaryType):
        return F.hex(column(name))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        fraction = F.when(F.extract(F.lit("SECOND"), column(name)) % 1 != 0, F.date_format(column(name), ".SSSSSS"))
        return F.concat(F.date_format(column(name), "yyyy-MM-dd HH:mm:ss"), F.coalesce(fraction, F.lit("")))
    return F.to_json(column(name)) if kind == "nested" else column(name)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)
