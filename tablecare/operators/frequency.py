"""Regular spacing of timestamps, found without sorting them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400_000_000
MIN_VALUES = 4

# Unit names from the longest to the shortest, in microseconds.
UNITS = (("D", DAY), ("h", 3_600_000_000), ("min", 60_000_000), ("s", 1_000_000), ("ms", 1_000), ("us", 1))
WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")

_EPOCH = dt.datetime(1970, 1, 1)


def _moment(micros: int) -> dt.datetime:
    return _EPOCH + dt.timedelta(microseconds=micros)


def _times(count: int, name: str) -> str:
    return name if count == 1 else f"{count}{name}"


def _month_number(micros: int) -> int:
    moment = _moment(micros)
    return moment.year * 12 + moment.month - 1


def _workday_number(micros: int) -> int:
    days = micros // DAY + 3            # the epoch was a Thursday; weeks start on Monday
    return days // 7 * 5 + days % 7


def _steps(low: int, high: int, rows: int) -> int | None:
    """The step by which *rows* evenly spaced numbers go from low to high."""
    return (high - low) // (rows - 1) if high > low and (high - low) % (rows - 1) == 0 else None


def _fixed_name(step: int, last: int) -> str:
    if step % (7 * DAY) == 0:
        return _times(step // (7 * DAY), f"W-{WEEKDAYS[_moment(last).weekday()]}")
    unit, size = next((u, s) for u, s in UNITS if step % s == 0)
    return _times(step // size, unit)


def _month_name(months: int, first: int, edge: str) -> str:
    month = _moment(first).month
    if months % 12 == 0:
        return _times(months // 12, f"Y{edge}-{MONTHS[month - 1]}")
    if months % 3 == 0:
        # quarters are named after the last of the three months that start or end one
        return _times(months // 3, f"Q{edge}-{MONTHS[(month - 1) % 3 + 9]}")
    return _times(months, f"M{edge}")


def infer_frequency(df: DataFrame, columns: dict[str, Column]) -> dict[str, str | None]:
    """A frequency name per timestamp column, or None when it is not regular.

    Known: every fixed step (``D``, ``2h``, ``W-SUN``), month, quarter and year
    starts and ends (``MS``, ``QE-DEC``, ``YS-JAN``) and working days (``B``).
    Only columns that pass all cheap tests are counted for duplicates.
    """
    names = list(columns)
    result: dict[str, str | None] = dict.fromkeys(names)
    if not names:
        return result
    micros = df.select(*[F.unix_micros(columns[n].cast("timestamp")).alias(f"t{i}") for i, n in enumerate(names)])
    spans = micros.agg(
        *[F.struct(F.count(f"t{i}"), F.min(f"t{i}"), F.max(f"t{i}")).alias(f"t{i}") for i in range(len(names))]
    ).first()

    # (column, priority, name, slot of each row, test that every row must pass)
    candidates: list[tuple[int, int, str, Column, Column]] = []
    for i in range(len(names)):
        rows, low, high = spans[f"t{i}"]
        if rows < MIN_VALUES or low == high:
            continue
        t = F.col(f"t{i}")
        day = F.to_date(F.timestamp_micros(t))
        same_time = (t - low) % DAY == 0
        months = _steps(_month_number(low), _month_number(high), rows)
        if months:
            number = F.year(day) * 12 + F.month(day) - 1
            on_step = same_time & ((number - _month_number(low)) % months == 0)
            starts, ends = F.dayofmonth(day) == 1, day == F.last_day(day)
            candidates.append((i, 0, _month_name(months, low, "S"), number, on_step & starts))
            candidates.append((i, 0, _month_name(months, low, "E"), number, on_step & ends))
        step = _steps(low, high, rows)
        if step:
            candidates.append((i, 1, _fixed_name(step, high), t, (t - low) % step == 0))
        if _workday_number(high) - _workday_number(low) == rows - 1:
            candidates.append((i, 2, "B", t, same_time & (F.weekday(day) < 5)))

    def keep(measure, wanted) -> None:
        nonlocal candidates
        if candidates:
            seen = micros.agg(*[measure(c).alias(f"c{j}") for j, c in enumerate(candidates)]).first()
            candidates = [c for c, v in zip(candidates, seen) if v == wanted(c)]

    keep(lambda c: F.bool_and(c[4]), lambda c: True)
    keep(lambda c: F.count_distinct(c[3]), lambda c: spans[f"t{c[0]}"][0])
    for i, _, name, _, _ in sorted(candidates, key=lambda c: -c[1]):
        result[names[i]] = name
    return result
