"""Column expressions shared by all operators; none of them leaves the JVM."""

from tablecare.functions.dates import DEFAULT_FORMATS, iso, parse_timestamp, period_label, whole_days
from tablecare.functions.numbers import finite, looks_number, nan_to_null, parse_number
from tablecare.functions.text import label_key, missing_to_null, snake, strip, title

__all__ = [
    "DEFAULT_FORMATS", "finite", "iso", "label_key", "looks_number", "missing_to_null", "nan_to_null",
    "parse_number", "parse_timestamp", "period_label", "snake", "strip", "title", "whole_days",
]
