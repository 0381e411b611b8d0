"""Cleaning plans: screening, order of the steps, and the run."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tablecare.operators.clean import Clip, Dedupe, Fill, MapLabels, Op
from tablecare.operators.schema import column, kinds

# The order in which kinds of steps run; others come last.
RUN_ORDER = (
    "rename_columns", "fix_whitespace", "fix_dtype", "fix_mixed_types", "fill_missing",
    "drop_missing", "drop_duplicates", "drop_column", "clip_outliers", "standardize_categories",
)
_LOG = "position int, id string, type string, status string, detail string"


def _rank(op: Op) -> int:
    return RUN_ORDER.index(op.type) if op.type in RUN_ORDER else len(RUN_ORDER)


@dataclass(frozen=True)
class Plan:
    """Steps that clean a table. All of it is lazy but for steps that measure."""

    ops: tuple[Op, ...]

    def __init__(self, ops: Iterable[Op]):
        object.__setattr__(self, "ops", tuple(ops))

    def select(self, ids: Sequence[str]) -> "Plan":
        """Only the steps with these ids."""
        return Plan(op for op in self.ops if op.id in ids)

    def of_type(self, type: str) -> list[Op]:
        return [op for op in self.ops if op.type == type]

    def screen(self, columns: Sequence[str]) -> "Plan":
        """Without the steps that name a column the table does not have."""
        return Plan(op for op in self.ops if set(op.columns()) <= set(columns))

    def sorted(self) -> "Plan":
        """In run order; steps of one kind keep their order."""
        return Plan(sorted(self.ops, key=_rank))

    def observed(self, df: DataFrame, only_ids: Sequence[str] | None = None) -> tuple[DataFrame, "StepCounts"]:
        """As :meth:`apply`, and what each step did to the rows is counted on the way.

        The counts ride along with whatever is done with the new table first (writing it, say), which has to read all of it; no
        job is added. See :class:`StepCounts`.
        """
        start = Observation()
        counts = StepCounts(df.sparkSession, start)
        done, _ = self._run(df.observe(start, F.count(F.lit(1)).alias("rows")), only_ids, counts)
        return done, counts

    def apply(self, df: DataFrame, only_ids: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """Run the steps; return the new table and the log.

        Later steps may name columns as they were before a rename. A step that
        fails is skipped and leaves the table as it was. Neighbouring fills by
        mean or median share their scan; what is measured after a shuffle is kept
        on disk while it is measured.
        """
        done, log = self._run(df, only_ids, None)
        return done, df.sparkSession.createDataFrame(log, _LOG)

    def _run(self, df: DataFrame, only_ids: Sequence[str] | None, counts: "StepCounts | None") -> tuple[DataFrame, list[tuple]]:
        plan = self.select(only_ids) if only_ids is not None else self
        log: list[tuple] = []
        names: dict[str, str] = {}
        shuffled = False
        for group in _groups(plan.ops):
            steps = [_measured_once(op.renamed(names), shuffled) for op in group]
            shuffled = shuffled or any(isinstance(op, (Dedupe, MapLabels)) for op in group)
            if len(steps) > 1:
                merged = replace(steps[0], cols=[c for s in steps for c in s.cols])
                done, error = _try(merged, df, steps, counts)
                steps_done = [(op, done, None) for op in group] if error is None else []
            else:
                steps_done = []
            if not steps_done:
                current = df
                for op, step in zip(group, steps):
                    done, error = _try(step, current, [step], counts)
                    if error is None:
                        names.update(names_after(names, step.mapping(current)))
                        current = done
                    steps_done.append((op, current, error))
            for op, _, error in steps_done:
                log.append((len(log), op.id, op.type, "ok" if error is None else "skip", error or ""))
            df = steps_done[-1][1]
        if counts is not None:
            counts.log = log
        return df, log


def _measured_once(op: Op, shuffled: bool) -> Op:
    return replace(op, keep=True) if shuffled and isinstance(op, (Clip, Fill)) else op


def _try(op: Op, df: DataFrame, parts: Sequence[Op], counts: "StepCounts | None") -> tuple[DataFrame, str | None]:
    """The table after a step, or as it was and the error. *parts*: the steps of the plan that *op* stands for."""
    try:
        if counts is not None and op.row_wise:
            # what fails does so on a table without rows, as Spark reports a failure to all that observe the plan
            op.apply(df.sparkSession.createDataFrame([], df.schema)).schema
        copies = _copies(df, parts) if counts is not None else []
        done = op.apply(df.withColumns({name: column(c) for of in copies for c, name in of.items()}))
        done.schema  # names and types are resolved here, also by a remote session
    except (PySparkException, ValueError, KeyError, TypeError) as error:
        if counts is not None and len(parts) == 1:
            counts.steps.append(None)
        return df, f"{type(error).__name__}: {str(error).splitlines()[0]}"
    if counts is None:
        return done, None
    seen = Observation()
    changed = [_changed(done, of).alias(f"changed{i}") for i, of in enumerate(copies)]
    counts.steps += [(seen, i) for i in range(len(parts))]
    done = done.observe(seen, F.count(F.lit(1)).alias("rows"), *changed)
    return done.drop(*[name for of in copies for name in of.values()]), None


def _copies(df: DataFrame, parts: Sequence[Op]) -> list[dict[str, str]]:
    """Per step, the columns that it may change, and the name of each one's copy; a step over whole rows has none."""
    kind = kinds(df)
    return [{c: f"__before {i} {c}" for c in op.columns() if kind.get(c, "nested") != "nested"} if op.row_wise or isinstance(op, (Fill, Clip, MapLabels)) else {}
            for i, op in enumerate(parts)]


def _changed(done: DataFrame, copies: dict[str, str]) -> Column:
    """Rows with another value in one of the columns; where the type is another, rows that lost theirs. Null where nothing is comparable."""
    types = {f.name: f.dataType for f in done.schema.fields}
    there = {c: name for c, name in copies.items() if c in types and name in types}
    tests = [~column(c).eqNullSafe(column(name)) if types[c] == types[name] else column(name).isNotNull() & column(c).isNull() for c, name in there.items()]
    return F.count_if(reduce(lambda a, b: a | b, tests)) if tests else F.max(F.lit(None).cast("bigint"))


class StepCounts:
    """What the steps of a plan did: known once the table they made was read as a whole."""

    def __init__(self, spark: SparkSession, start: Observation):
        self.spark, self.start = spark, start
        self.steps: list[tuple[Observation, int] | None] = []
        self.log: list[tuple] = []

    def frame(self) -> DataFrame:
        """(position, id, type, status, detail, rows_in, rows_out, changed) of each step; it waits for the table to be read.

        changed: rows with another value in a column that the step names, or, where it makes another type of it, rows that lost their
        value; null for steps over whole rows. A skipped step has its reason, and the rows it left as they were.
        """
        rows, out = self.start.get["rows"], []
        for entry, step in zip(self.log, self.steps):
            before = rows
            seen = step[0].get if step else {}
            rows = seen.get("rows", rows)
            out.append((*entry, before, rows, seen.get(f"changed{step[1]}") if step else 0))
        return self.spark.createDataFrame(out, f"{_LOG}, rows_in bigint, rows_out bigint, changed bigint")


def names_after(before: dict[str, str], new: dict[str, str]) -> dict[str, str]:
    """Names known so far, followed through another rename."""
    return {**{old: new.get(name, name) for old, name in before.items()}, **new}


def _groups(ops: Sequence[Op]) -> list[list[Op]]:
    """Neighbouring fills of one kind on different columns, together."""
    groups: list[list[Op]] = []
    for op in ops:
        last = groups[-1] if groups else []
        if (
            isinstance(op, Fill) and op.how in ("mean", "median") and last
            and isinstance(last[-1], Fill) and last[-1].how == op.how
            and not set(op.cols) & {c for o in last for c in o.cols}
        ):
            last.append(op)
        else:
            groups.append([op])
    return groups
