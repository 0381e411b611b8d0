"""Column helpers for text: stripping, title case, snake case, missing labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space, so that tabs and no-break spaces
# are stripped as well (SQL trim alone removes only the plain space).
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

# Spellings of "missing" that are unified by default, compared in lower case.
MISSING_LABELS = ("n/a", "na")


def strip(c: Column) -> Column:
    """Remove white space at both ends. Only the ends are looked at, no regex."""
    return F.trim(c, F.lit(WHITESPACE))


def label_key(c: Column) -> Column:
    """The form under which spellings of one label are grouped."""
    return F.lower(strip(c))


def title(c: Column) -> Column:
    """Capital first letter of every run of letters, the rest in lower case.

    ``initcap`` starts a word only after a space; here ``o'neil`` becomes
    ``O'Neil`` and ``3m`` becomes ``3M``.
    """
    runs = F.regexp_extract_all(
        F.lower(c), F.lit(r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"), F.lit(1)
    )
    return F.array_join(
        F.transform(
            runs,
            lambda run: F.concat(F.upper(F.substring(run, 1, 1)), run.substr(F.lit(2), F.length(run))),
        ),
        "",
    )


def snake(c: Column) -> Column:
    """A column name in snake_case; ``unnamed`` when nothing is left."""
    split_caps = F.regexp_replace(strip(c), r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    split_humps = F.regexp_replace(split_caps, r"([a-z0-9])([A-Z])", "$1_$2")
    words = F.regexp_replace(F.lower(split_humps), r"[^a-z0-9]+", "_")
    name = F.trim(words, F.lit("_"))
    return (
        F.when(name == "", F.lit("unnamed"))
        .when(name.rlike("^[0-9]"), F.concat(F.lit("col_"), name))
        .otherwise(name)
    )


def missing_to_null(c: Column, labels=MISSING_LABELS) -> Column:
    """Null where the stripped, lower-cased text is one of *labels*."""
    return F.when(~F.coalesce(label_key(c).isin(*labels), F.lit(False)), c)
