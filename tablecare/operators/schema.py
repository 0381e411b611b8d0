"""What kind of data a column holds, read from the schema alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = (
    ("boolean", (T.BooleanType,)),
    ("datetime", (T.TimestampType, T.TimestampNTZType, T.DateType)),
    ("integer", (T.ByteType, T.ShortType, T.IntegerType, T.LongType)),
    ("fraction", (T.FloatType, T.DoubleType, T.DecimalType)),
    ("text", (T.StringType, T.CharType, T.VarcharType)),
)


def kind_of(dtype: T.DataType) -> str:
    """boolean, datetime, integer, fraction, text or nested."""
    return next((kind for kind, types in _KINDS if isinstance(dtype, types)), "nested")


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def column(name: str) -> Column:
    """The column of this very name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into null, as a missing value."""
    dtype = df.schema[name].dataType
    c = column(name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    return c


def _ordered(c: Column, dtype: T.DataType) -> Column:
    """The value with the entries of maps, at any depth, as arrays in order."""
    if isinstance(dtype, T.MapType):
        pairs = F.transform(F.map_entries(c), lambda e: F.struct(
            F.to_json(F.array(_ordered(e["key"], dtype.keyType))).alias("key"), F.to_json(F.array(_ordered(e["value"], dtype.valueType))).alias("value")))
        return F.sort_array(pairs)
    if isinstance(dtype, T.ArrayType) and _has_map(dtype):
        return F.transform(c, lambda x: _ordered(x, dtype.elementType))
    if isinstance(dtype, T.StructType) and _has_map(dtype):
        return F.when(c.isNotNull(), F.struct(*[_ordered(c.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]))
    return c


def _has_map(dtype: T.DataType) -> bool:
    inner = [dtype.elementType] if isinstance(dtype, T.ArrayType) else [f.dataType for f in dtype.fields] if isinstance(dtype, T.StructType) else []
    return isinstance(dtype, T.MapType) or any(map(_has_map, inner))


def as_text(df: DataFrame, name: str) -> Column:
    """A text form in which equal values, and only those, are equal."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(_ordered(column(name), dtype))
    if isinstance(dtype, T.BinaryType):
        return F.hex(column(name))
    return column(name).cast("string")
