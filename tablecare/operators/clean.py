"""Cleaning operations: small declarations that turn a DataFrame into another.

Row-wise operations are plain projections and filters; they also accept a
streaming DataFrame. Operations that need figures of the whole column (fill,
clip, label map) compute them once with an aggregate when applied and put them
into the plan as literals, so the table itself is neither joined nor shuffled.
No step can fail on a value at run time: what does not parse becomes null, and
SQL of the user is planned with ANSI mode off, where a bad cast, a zero divisor
or an index out of range gives null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any, ClassVar

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablecare.functions.dates import DEFAULT_FORMATS, parse_timestamp
from tablecare.functions.numbers import finite, parse_number
from tablecare.functions.text import MISSING_LABELS, label_key, missing_to_null, strip, title
from tablecare.operators.catalog import unique_snake_names
from tablecare.operators.histogram import top_values, value_counts
from tablecare.operators.jobs import together
from tablecare.operators.joins import small_side
from tablecare.operators.quantiles import exact_quantiles
from tablecare.operators.schema import as_text, column, kinds, present


@dataclass(frozen=True)
class Op:
    """One cleaning step. ``type`` is its place in the run order of a plan."""

    type: ClassVar[str] = ""
    row_wise: ClassVar[bool] = True
    id: str = field(default="", kw_only=True)
    description: str = field(default="", kw_only=True)

    def columns(self) -> list[str]:
        """The columns this step needs, for screening."""
        return list(getattr(self, "cols", None) or [])

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def renamed(self, names: Mapping[str, str]) -> "Op":
        """This step with column names replaced by those after a rename."""
        changes: dict[str, Any] = {}
        for key in ("cols", "subset", "order_by"):
            value = getattr(self, key, None)
            if value:
                changes[key] = [names.get(c, c) for c in value]
        col = getattr(self, "col", None)
        if col is not None:
            changes["col"] = names.get(col, col)
        return replace(self, **changes) if changes else self

    def mapping(self, df: DataFrame) -> dict[str, str]:
        """Old to new names of the columns this step renames."""
        return {}


def _need_text(df: DataFrame, cols: Sequence[str]) -> None:
    kind = kinds(df)
    wrong = [c for c in cols if kind.get(c) not in ("text", None)]
    if wrong:
        raise ValueError(f"not text: {', '.join(wrong)}")


def _with(df: DataFrame, cols: Sequence[str], f) -> DataFrame:
    """The columns replaced by *f* of them, in one projection."""
    return df.withColumns({c: f(column(c)) for c in cols})


@dataclass(frozen=True)
class Rename(Op):
    """Rename columns by an explicit map."""

    type: ClassVar[str] = "rename_columns"
    names: Mapping[str, str] = field(default_factory=dict)

    def columns(self) -> list[str]:
        return list(self.names)

    def mapping(self, df: DataFrame) -> dict[str, str]:
        return dict(self.names)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumnsRenamed(dict(self.names))


@dataclass(frozen=True)
class SnakeCase(Op):
    """Rename all columns to snake_case, with ``_2``, ``_3`` … on collisions."""

    type: ClassVar[str] = "rename_columns"

    def mapping(self, df: DataFrame) -> dict[str, str]:
        return dict(zip(df.columns, unique_snake_names(df.sparkSession, df.columns)))

    def apply(self, df: DataFrame) -> DataFrame:
        return df.toDF(*unique_snake_names(df.sparkSession, df.columns))


@dataclass(frozen=True)
class Strip(Op):
    """Remove white space around texts."""

    type: ClassVar[str] = "fix_whitespace"
    cols: Sequence[str] = ()

    def apply(self, df: DataFrame) -> DataFrame:
        _need_text(df, self.cols)
        return _with(df, self.cols, strip)


@dataclass(frozen=True)
class ToNumber(Op):
    """Texts to doubles; what is no number becomes null."""

    type: ClassVar[str] = "fix_dtype"
    cols: Sequence[str] = ()

    def apply(self, df: DataFrame) -> DataFrame:
        return _with(df, self.cols, lambda c: parse_number(c.cast("string")))


@dataclass(frozen=True)
class ToTimestamp(Op):
    """Texts to timestamps by the declared formats, in their order."""

    type: ClassVar[str] = "fix_dtype"
    cols: Sequence[str] = ()
    formats: Sequence[str] = DEFAULT_FORMATS

    def apply(self, df: DataFrame) -> DataFrame:
        return _with(df, self.cols, lambda c: parse_timestamp(c.cast("string"), self.formats))


@dataclass(frozen=True)
class SplitMixed(Op):
    """Numbers of a mixed column to doubles; other texts go to ``<col>_raw``."""

    type: ClassVar[str] = "fix_mixed_types"
    cols: Sequence[str] = ()

    def apply(self, df: DataFrame) -> DataFrame:
        new = {}
        for c in self.cols:
            number = parse_number(column(c))
            new[c] = number
            new[f"{c}_raw"] = F.when(number.isNull(), column(c))
        return df.withColumns(new)


@dataclass(frozen=True)
class MissingLabels(Op):
    """Labels that mean "missing" (n/a, NA …) become null, before values are filled."""

    type: ClassVar[str] = "fix_mixed_types"
    cols: Sequence[str] = ()
    labels: Sequence[str] = MISSING_LABELS

    def apply(self, df: DataFrame) -> DataFrame:
        return _with(df, self.cols, lambda c: missing_to_null(c, self.labels))


def most_frequent(df: DataFrame, cols: Sequence[str]) -> list[Any]:
    """The most frequent value of each column, the smallest of several; None without values.

    Columns of one type are counted by one scan.
    """
    families: dict[str, dict[str, Column]] = {}
    for i, c in enumerate(cols):
        families.setdefault(df.schema[c].dataType.simpleString(), {})[str(i)] = present(df, c)
    rows = together(*[lambda f=f: top_values(value_counts(df, f), 1).select("pos", "value").collect() for f in families.values()])
    found = {int(r["pos"]): r["value"] for part in rows for r in part}
    return [found.get(i) for i in range(len(cols))]


@dataclass(frozen=True)
class Fill(Op):
    """Replace missing values by the median, mean or mode, or by a constant."""

    type: ClassVar[str] = "fill_missing"
    row_wise: ClassVar[bool] = False
    cols: Sequence[str] = ()
    how: str = "median"          # median, mean, mode or value
    value: Any = None
    keep: bool = field(default=False, kw_only=True)  # see exact_quantiles

    def fills(self, df: DataFrame) -> dict[str, Any]:
        numbers = {c: finite(column(c)) for c in self.cols}
        if self.how == "value":
            return dict.fromkeys(self.cols, self.value)
        if self.how == "mode":
            return dict(zip(self.cols, most_frequent(df, self.cols)))
        if self.how == "mean":
            row = df.agg(*[F.avg(v).alias(str(i)) for i, v in enumerate(numbers.values())]).first()
            return dict(zip(self.cols, row))
        if self.how == "median":
            return {c: q[0] for c, q in exact_quantiles(df, numbers, [0.5], keep=self.keep)[0].items()}
        raise ValueError(f"unknown fill {self.how!r}")

    def apply(self, df: DataFrame) -> DataFrame:
        kind = kinds(df)
        filled = {}
        for c, fill in self.fills(df).items():
            if fill is None:
                continue
            whole = kind[c] == "integer" and float(fill).is_integer()
            # a whole-number column stays one unless the fill has a fraction
            dtype = "double" if kind[c] == "integer" and not whole else df.schema[c].dataType
            filled[c] = F.coalesce(present(df, c).cast(dtype), F.lit(fill).try_cast(dtype))
        return df.withColumns(filled) if filled else df


@dataclass(frozen=True)
class DropMissing(Op):
    """Drop rows with a missing value in any, or in the given, columns."""

    type: ClassVar[str] = "drop_missing"
    cols: Sequence[str] | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        names = list(self.cols) if self.cols else df.columns
        return df.where(reduce(lambda a, b: a & b, [present(df, c).isNotNull() for c in names])) if names else df


@dataclass(frozen=True)
class Dedupe(Op):
    """Keep one row of each set of equal rows.

    With *subset* the first row by *order_by* is kept. Spark keeps one row per
    key in every task before it shuffles, so a hot key stays cheap.
    """

    type: ClassVar[str] = "drop_duplicates"
    row_wise: ClassVar[bool] = False
    subset: Sequence[str] | None = None
    order_by: Sequence[str] | None = None

    def columns(self) -> list[str]:
        return [*(self.subset or []), *(self.order_by or [])]

    def apply(self, df: DataFrame) -> DataFrame:
        if not self.subset:
            # equal by their keys: NaN is as missing, and entries of a map have no order
            keys = {f"__k{i}": F.coalesce(as_text(df, c), F.lit("")) if k == "nested" else present(df, c) for i, (c, k) in enumerate(kinds(df).items())}
            return df.withColumns(keys).dropDuplicates(list(keys)).drop(*keys) if keys else df
        if not self.order_by:
            raise ValueError("order_by is needed to know the first row of a subset")
        w = Window.partitionBy(*[column(c) for c in self.subset]).orderBy(*[column(c) for c in self.order_by])
        return df.withColumn("__nth", F.row_number().over(w)).where(F.col("__nth") == 1).drop("__nth")


@dataclass(frozen=True)
class Drop(Op):
    """Drop columns."""

    type: ClassVar[str] = "drop_column"
    cols: Sequence[str] = ()

    def apply(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.cols)


@dataclass(frozen=True)
class Clip(Op):
    """Pull outliers to ``q1 - k*iqr`` and ``q3 + k*iqr``."""

    type: ClassVar[str] = "clip_outliers"
    row_wise: ClassVar[bool] = False
    cols: Sequence[str] = ()
    k: float = 1.5
    keep: bool = field(default=False, kw_only=True)  # see exact_quantiles

    def apply(self, df: DataFrame) -> DataFrame:
        values = {c: finite(column(c)) for c in self.cols}
        quartiles, _ = exact_quantiles(df, values, [0.25, 0.75], keep=self.keep)
        new = {}
        for c, (q1, q3) in quartiles.items():
            if q1 is None:
                continue
            low, high = q1 - self.k * (q3 - q1), q3 + self.k * (q3 - q1)
            value = present(df, c).cast("double")
            new[c] = F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))
        return df.withColumns(new) if new else df


@dataclass(frozen=True)
class Title(Op):
    """Strip and title-case labels."""

    type: ClassVar[str] = "standardize_categories"
    cols: Sequence[str] = ()

    def apply(self, df: DataFrame) -> DataFrame:
        _need_text(df, self.cols)
        return _with(df, self.cols, lambda c: title(strip(c)))


def label_spellings(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, label, spellings, rows, canonical)`` of labels in several spellings.

    *label* is the stripped lower-case form, *canonical* the most frequent
    spelling. Counted per spelling first, so hot labels are small.
    """
    by_pos = {str(i): as_text(df, c) for i, c in enumerate(cols)}
    names = F.array(*[F.lit(c) for c in cols])
    counts = (
        df.select(*[c.alias(p) for p, c in by_pos.items()])
        .unpivot([], list(by_pos), "pos", "value").where(F.col("value").isNotNull())
        .groupBy("pos", "value").agg(F.count("*").alias("n"))
    )
    return (
        counts.groupBy("pos", label_key(F.col("value")).alias("label"))
        .agg(
            F.count("*").alias("spellings"),
            F.sum("n").alias("rows"),
            F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("canonical"),
        )
        .where(F.col("spellings") > 1)
        .select(F.element_at(names, F.col("pos").cast("int") + 1).alias("column"),
                "label", "spellings", "rows", "canonical")
    )


@dataclass(frozen=True)
class MapLabels(Op):
    """Replace every spelling of a label by its most frequent one."""

    type: ClassVar[str] = "standardize_categories"
    row_wise: ClassVar[bool] = False
    col: str = ""

    def columns(self) -> list[str]:
        return [self.col]

    def apply(self, df: DataFrame) -> DataFrame:
        labels = label_spellings(df, [self.col]).select(F.col("label").alias("__label"), F.col("canonical").alias("__canonical"))
        side = small_side(labels)
        new = F.coalesce(F.col("__canonical"), column(self.col)).alias(self.col)
        return (
            df.join(side, label_key(column(self.col)) == F.col("__label"), "left")
            .select(*[new if c == self.col else column(c) for c in df.columns])
        )


@dataclass(frozen=True)
class Derive(Op):
    """Add a column from a SQL expression."""

    type: ClassVar[str] = "derive_column"
    name: str = ""
    sql: str = ""

    def columns(self) -> list[str]:
        return names_in(self.sql)

    def apply(self, df: DataFrame) -> DataFrame:
        with lenient(df.sparkSession):
            return df.withColumn(self.name, expression(self.sql))


@dataclass(frozen=True)
class Matches(Op):
    """Add a boolean column: does the text contain a match of the pattern?"""

    type: ClassVar[str] = "derive_column"
    name: str = ""
    col: str = ""
    pattern: str = ""

    def columns(self) -> list[str]:
        return [self.col]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.name, column(self.col).rlike(self.pattern))


@dataclass(frozen=True)
class Where(Op):
    """Keep the rows for which a SQL predicate holds."""

    type: ClassVar[str] = "filter_rows"
    sql: str = ""

    def columns(self) -> list[str]:
        return names_in(self.sql)

    def apply(self, df: DataFrame) -> DataFrame:
        with lenient(df.sparkSession):
            return df.where(expression(self.sql))


@dataclass(frozen=True)
class Head(Op):
    """Keep the first *n* rows by the given order (a top-k, not a full sort)."""

    type: ClassVar[str] = "filter_rows"
    row_wise: ClassVar[bool] = False
    n: int = 5
    order_by: Sequence[str] = ()

    def columns(self) -> list[str]:
        return list(self.order_by)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.orderBy(*[column(c) for c in self.order_by]).limit(self.n)


# Functions that run Java code by name are not accepted in expressions.
_REFUSED = ("reflect", "java_method", "try_reflect")


@contextmanager
def lenient(spark: SparkSession) -> Iterator[None]:
    """What is planned inside gives null where ANSI mode would fail."""
    key = "spark.sql.ansi.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


# Names that stand for a value where the table has no such column.
_VALUES = frozenset(("current_date", "current_timestamp", "current_time", "localtimestamp", "current_user", "user", "session_user"))


def names_in(sql: str) -> list[str]:
    """The columns that a SQL expression names, from its parsed tree; of a struct's field the struct.

    Whether a word is a column is the parser's decision, so a column may be called ``year`` or ``date``. Variables that a lambda
    binds are no columns. An expression that does not parse names none; it fails when applied.
    """
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("expressions are read by Spark's parser: start a session first")
    try:
        tree = spark._jsparkSession.sessionState().sqlParser().parseExpression(sql)
    except PySparkException:
        return []
    return list(dict.fromkeys(n for n in _named(tree, frozenset()) if n.lower() not in _VALUES))


def _named(node, bound: frozenset[str]) -> Iterator[str]:
    kind = node.getClass().getSimpleName()
    if kind in ("UnresolvedAttribute", "UnresolvedNamedLambdaVariable"):
        first = node.nameParts().apply(0)
        if kind == "UnresolvedAttribute" or first.lower() not in bound:
            yield first
        return
    children = node.children()
    parts = [children.apply(i) for i in range(children.size())]
    if kind == "LambdaFunction":  # the body, then what it binds
        bound = bound | {p.nameParts().apply(0).lower() for p in parts[1:]}
        parts = parts[:1]
    for part in parts:
        yield from _named(part, bound)


def expression(sql: str) -> Column:
    """A SQL expression as a Column; calls into arbitrary Java code are refused."""
    called = {m.lower() for m in re.findall(r"`?(\w+)`?\s*\(", sql)}
    refused = sorted(called & set(_REFUSED))
    if refused:
        raise ValueError(f"not allowed in an expression: {', '.join(refused)}")
    return F.expr(sql)
