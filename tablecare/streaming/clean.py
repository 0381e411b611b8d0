"""Cleaning of streams: the row-wise steps of a plan on a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tablecare.plans.plan import Plan, names_after


def clean_stream(df: DataFrame, plan: Plan) -> DataFrame:
    """Apply a plan to a stream. Steps that look at more than one row are refused."""
    wide = [op.id or op.type for op in plan.ops if not op.row_wise]
    if wide:
        raise ValueError(f"not row-wise, needs a finished table: {', '.join(wide)}")
    names: dict[str, str] = {}
    for op in plan.ops:
        step = op.renamed(names)
        new = step.mapping(df)
        names = names_after(names, new)
        df = step.apply(df)
    return df
