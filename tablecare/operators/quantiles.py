"""Exact quantiles of any number of rows without sorting them.

``percentile`` keeps every distinct value of a column in one task, so it is
used only where the rows, counted first, are few. Beyond that a mergeable
sketch brackets each wanted rank, a scan counts the rows around the brackets,
and the few values inside are picked out. A bracket that still holds too many
values is narrowed by a sketch of its inside, hundreds of times per round.
Every scan ends in one aggregate of a few rows; no rows are shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tablecare.operators.histogram import tall
from tablecare.operators.jobs import together

ACCURACY = 10_000        # rank error of the sketch is rows / ACCURACY
GRID = 1_000             # points of the sketch read inside a bracket
COLUMNS_TOGETHER = 50    # columns whose sketches share an aggregate
VALUES_HELD = 2_000_000  # values one aggregate may hold, over all columns


@dataclass(frozen=True)
class _Bracket:
    """Rows of a column strictly between two values; None for an open end."""

    column: int
    low: float | None
    high: float | None

    def holds(self, v: Column) -> Column:
        test = v.isNotNull()
        if self.low is not None:
            test = test & (v > self.low)
        return test & (v < self.high) if self.high is not None else test


def _counts(values: DataFrame, brackets: list[_Bracket]) -> dict[_Bracket, tuple[int, int, int, int]]:
    """Rows below low, up to low, below high and up to high of each bracket.

    Each value is put into the slot between, or on, the bounds of its column;
    the narrow (column, slot) rows are counted with map-side combine.
    """
    bounds = {
        c: sorted({x for b in brackets if b.column == c for x in (b.low, b.high) if x is not None})
        for c in {b.column for b in brackets}
    }

    def slot(c: int) -> Column:
        v = F.col(f"q{c}")
        chain = F.when(v.isNull(), F.lit(None).cast("int"))
        for i, bound in enumerate(bounds[c]):
            chain = chain.when(v < bound, F.lit(2 * i)).when(v == bound, F.lit(2 * i + 1))
        return chain.otherwise(F.lit(2 * len(bounds[c])))

    slots = values.select(*[slot(c).alias(str(c)) for c in bounds])
    seen = slots.unpivot([], [str(c) for c in bounds], "column", "slot").groupBy("column", "slot").count().collect()
    per_column = {c: [0] * (2 * len(x) + 1) for c, x in bounds.items()}
    for r in seen:
        if r["slot"] is not None:
            per_column[int(r["column"])][r["slot"]] = r["count"]

    def rows(c: int, bound: float | None, inclusive: bool, none: int) -> int:
        if bound is None:
            return none
        return sum(per_column[c][: 2 * bounds[c].index(bound) + 1 + inclusive])

    return {
        b: (
            rows(b.column, b.low, False, 0), rows(b.column, b.low, True, 0),
            rows(b.column, b.high, False, sum(per_column[b.column])),
            rows(b.column, b.high, True, sum(per_column[b.column])),
        )
        for b in brackets
    }


def _inside(values: DataFrame, brackets: list[_Bracket], measures: dict[int, Column]) -> dict[int, list]:
    """One measure over the values inside each bracket, by bracket number.

    The few values that are inside any bracket of their column are stacked, and
    then handed to every bracket that holds them.
    """
    near = {}
    for c in sorted({b.column for b in brackets}):
        v = F.col(f"q{c}")
        near[str(c)] = F.when(reduce(Column.__or__, [b.holds(v) for b in brackets if b.column == c]), v)
    value = F.col("value")
    holders = F.array_compact(F.array(*[
        F.when((F.col("pos") == str(b.column)) & b.holds(value), F.lit(i)) for i, b in enumerate(brackets)
    ]))
    picked = tall(values, near).select(F.explode(holders).alias("bracket"), F.col("value").alias("v")).groupBy("bracket")
    wanted = F.coalesce(*[F.when(F.col("bracket") == i, m) for i, m in measures.items()])
    return {r["bracket"]: r["found"] for r in picked.agg(wanted.alias("found")).collect()}


def _sorted_inside(values: DataFrame, brackets: list[_Bracket]) -> dict[_Bracket, list]:
    if not brackets:
        return {}
    lists = _inside(values, brackets, {i: F.sort_array(F.collect_list("v")) for i in range(len(brackets))})
    return {b: lists.get(i, []) for i, b in enumerate(brackets)}


def _search(
    values: DataFrame, ranks: dict[tuple[int, int], _Bracket], may_hold: int, expected: float
) -> dict[tuple[int, int], float]:
    """The value of each (column, 0-based rank), from a bracket it is likely to be in.

    The sketch guarantees that at most *expected* rows are inside a bracket. If
    that is few enough, they are picked while the rows around are counted.
    """
    found: dict[tuple[int, int], float] = {}
    while ranks:
        brackets = list(dict.fromkeys(ranks.values()))
        if expected <= may_hold:
            around, lists = together(
                lambda: _counts(values, brackets), lambda: _sorted_inside(values, brackets)
            )
        else:
            around, lists = _counts(values, brackets), {}
        expected = math.inf
        inside: dict[_Bracket, list[tuple[int, int]]] = {}
        waiting: dict[tuple[int, int], _Bracket] = {}
        for (c, k), b in ranks.items():
            below, to_low, below_high, to_high = around[b]
            if k < below:                      # the sketch missed: look further down
                waiting[c, k] = _Bracket(c, None, b.low)
            elif k < to_low:
                found[c, k] = b.low
            elif k >= to_high:                 # the sketch missed: look further up
                waiting[c, k] = _Bracket(c, b.high, None)
            elif k >= below_high:
                found[c, k] = b.high
            else:
                inside.setdefault(b, []).append((c, k))
        small = [b for b in inside if around[b][2] - around[b][1] <= may_hold]
        large = [b for b in inside if b not in small]
        lists |= _sorted_inside(values, [b for b in small if b not in lists])
        for b in small:
            for c, k in inside[b]:
                found[c, k] = lists[b][k - around[b][1]]
        if large:
            grid = F.percentile_approx("v", [i / GRID for i in range(GRID + 1)], ACCURACY)
            grids = _inside(values, large, {i: grid for i in range(len(large))})
            for i, b in enumerate(large):
                _, to_low, below_high, _ = around[b]
                for c, k in inside[b]:
                    share = (k - to_low) / (below_high - to_low)
                    waiting[c, k] = _Bracket(
                        c, grids[i][max(0, math.floor(share * GRID) - 1)],
                        grids[i][min(GRID, math.ceil(share * GRID) + 1)],
                    )
        ranks = waiting
    return found


def exact_quantiles(
    df: DataFrame,
    columns: dict[str, Column],
    probs: list[float],
    extra: list[Column] | None = None,
    values_held: int = VALUES_HELD,
    keep: bool = False,
) -> tuple[dict[str, list[float | None]], Row]:
    """Linearly interpolated quantiles of each double column, nulls left out.

    *extra* aggregates ride along on the first scan, which counts the rows;
    their row is returned as the second part. With *keep* the columns are held
    on the executors' disks meanwhile, so that a shuffle before is done once.
    """
    if keep:
        return _kept_quantiles(df, columns, probs, values_held)
    if not columns and not extra:
        return {}, Row()
    if len(columns) > COLUMNS_TOGETHER:
        first, rest = (dict(list(columns.items())[part]) for part in (slice(COLUMNS_TOGETHER), slice(COLUMNS_TOGETHER, None)))
        found, extras = exact_quantiles(df, first, probs, extra, values_held)
        return found | exact_quantiles(df, rest, probs, None, values_held)[0], extras
    names = list(columns)
    margin = 2 / ACCURACY
    around = [min(max(p + side * margin, 0.0), 1.0) for p in probs for side in (-1, 1)]
    values = df.select(*[columns[n].alias(f"q{i}") for i, n in enumerate(names)])

    def count() -> Row:
        return df.agg(
            *[F.count(columns[n]).alias(f"q{i}") for i, n in enumerate(names)],
            *[e.alias(f"x{i}") for i, e in enumerate(extra or [])],
        ).first()

    def sketch() -> Row:
        return values.agg(
            *[F.percentile_approx(f"q{i}", around, ACCURACY).alias(f"q{i}") for i in range(len(names))]
        ).first()

    first, seen = together(count, sketch) if names else (count(), None)
    rows = [first[f"q{i}"] for i in range(len(names))]
    extras = Row(*[first[f"x{i}"] for i in range(len(extra or []))])
    result: dict[str, list[float | None]] = {n: [None] * len(probs) for n in names}
    may_hold = max(1_000, values_held // max(1, len(names) * len(probs)))
    filled = [i for i, n in enumerate(rows) if n]
    few = [i for i in filled if rows[i] <= may_hold]
    if few:
        exact = values.agg(*[F.percentile(f"q{i}", probs).alias(f"q{i}") for i in few]).first()
        for i in few:
            result[names[i]] = list(exact[f"q{i}"])

    ranks: dict[tuple[int, int], _Bracket] = {}
    many = [i for i in filled if i not in few]
    for i in many:
        for j, p in enumerate(probs):
            place = (rows[i] - 1) * p
            for k in {math.floor(place), math.ceil(place)}:
                ranks[i, k] = _Bracket(i, seen[f"q{i}"][2 * j], seen[f"q{i}"][2 * j + 1])
    expected = max((8 * rows[i] / ACCURACY for i in many), default=0)
    value = _search(values, ranks, may_hold, expected)
    for i in many:
        for j, p in enumerate(probs):
            place = (rows[i] - 1) * p
            low, high = value[i, math.floor(place)], value[i, math.ceil(place)]
            result[names[i]][j] = low + (high - low) * (place - math.floor(place))
    return result, extras


def _kept_quantiles(df: DataFrame, columns: dict[str, Column], probs: list[float], values_held: int):
    numbered = dict(enumerate(columns.values()))
    kept = df.select(*[c.alias(f"c{i}") for i, c in numbered.items()]).persist(StorageLevel.DISK_ONLY)
    try:
        kept.count()
        found, extras = exact_quantiles(kept, {str(i): F.col(f"c{i}") for i in numbered}, probs, None, values_held)
    finally:
        kept.unpersist()
    return {name: found[str(i)] for i, name in enumerate(columns)}, extras
