"""Broadcasts with a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 8 << 20
# What a row takes besides its texts.
_ROW = 64


def small_side(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """*df* marked for broadcast if its rows take at most *most* bytes, else as it is,
    so that Spark shuffles both sides and splits skewed keys."""
    size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns), F.lit(_ROW))
    return F.broadcast(df) if df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] <= most else df
