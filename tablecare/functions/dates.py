"""Column helpers for dates: parsing with declared formats and period labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablecare.functions.text import strip

# Tried in this order, so that 03/04/2023 is always the 4th of March.
DEFAULT_FORMATS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "MM/dd/yyyy",
    "dd/MM/yyyy",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "yyyy-MM-dd HH:mm:ssXXX",
    "yyyy/MM/dd",
    "MM-dd-yyyy",
    "dd-MM-yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
)

#: Every text that a default format can fit.
MAYBE_DATE = r"^(?:\d{1,4}[-/ ]|\p{L}{3,} \d)[^\n]{4,32}$"

_FIELD_SHAPES = {
    "yyyy": r"\d{4}", "yy": r"\d{2}", "MMMM": r"\p{L}{4,}", "MMM": r"\p{L}{3}",
    "MM": r"(?:0[1-9]|1[0-2])", "M": r"(?:0?[1-9]|1[0-2])",
    "dd": r"(?:0[1-9]|[12]\d|3[01])", "d": r"(?:0?[1-9]|[12]\d|3[01])",
    "HH": r"(?:[01]\d|2[0-3])", "H": r"(?:[01]?\d|2[0-3])", "mm": r"[0-5]\d", "ss": r"[0-5]\d",
    "SSSSSS": r"\d{1,6}", "XXX": r"(?:Z|[+-](?:0\d|1[0-8]):[0-5]\d)",
}


def format_shape(fmt: str) -> str | None:
    """A regex that texts of this format match, or None for an unknown field.

    It is tested before parsing: a failed parse costs an exception per value,
    a failed regex next to nothing. Months and days out of range fail here too,
    so that day-first dates do not fail as month-first ones in the parser.
    """
    shape = ""
    for quoted, field, other in re.findall(r"('(?:[^']|'')*')|([A-Za-z]+)|([^A-Za-z']+)", fmt):
        if quoted:
            shape += re.escape(quoted[1:-1].replace("''", "'") or "'")
        elif field:
            parts = [m.group(0) for m in re.finditer(r"(.)\1*", field)]
            if any(p not in _FIELD_SHAPES for p in parts):
                return None
            shape += "".join(_FIELD_SHAPES[p] for p in parts)
        else:
            shape += re.escape(other)
    return f"^{shape}$"


def parse_timestamp(c: Column, formats=DEFAULT_FORMATS) -> Column:
    """Text to timestamp by the first format that fits; null where none does."""
    text = strip(c)
    attempts = []
    for fmt in formats:
        parsed = F.try_to_timestamp(text, F.lit(fmt))
        shape = format_shape(fmt)
        attempts.append(F.when(text.rlike(shape), parsed) if shape else parsed)
    # most texts that are no dates fail this one test
    return F.when(text.rlike(MAYBE_DATE), F.coalesce(*attempts)) if formats == DEFAULT_FORMATS else F.coalesce(*attempts)


# period -> (label of the bucket a timestamp falls in, step between labels)
PERIODS = ("month", "week", "day")


def period_label(c: Column, period: str) -> Column:
    """Month end, the Sunday that ends the week, or the day itself."""
    day = F.to_date(c)
    if period == "month":
        return F.last_day(day)
    if period == "week":
        return F.next_day(F.date_sub(day, 1), "SU")
    return day


def whole_days(start: Column, end: Column) -> Column:
    """Whole days from start to end, rounded down also when negative."""
    seconds = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1_000_000)
    return F.floor(seconds / F.lit(86400))


def iso(c: Column) -> Column:
    """ISO text of a timestamp, with the fraction only where there is one."""
    fraction = F.when(
        F.unix_micros(c.cast("timestamp")) % 1_000_000 != 0, F.date_format(c, ".SSSSSS")
    ).otherwise(F.lit(""))
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), fraction)
