"""Tables of proposals: replies with cleaning plans or KPIs, one per data set.

Replies are texts that should hold JSON. They are unwrapped, parsed and checked
by column expressions; what does not fit goes to a reject table with a reason.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecare.functions.text import strip
from tablecare.operators.joins import small_side
from tablecare.plans.plan import RUN_ORDER

# The shapes of replies and the words they may use.
PLAN_FIELDS = (
    "id string, type string, description string, impact string, confidence string, "
    "reversible boolean, code string, column_names array<string>, alternatives array<string>"
)
PLAN_REQUIRED = ("id", "type", "description", "impact", "confidence", "reversible", "code")
PLAN_ALLOWED = {"type": RUN_ORDER, "confidence": ("high", "medium", "low")}
KPI_FIELDS = (
    "name string, category string, formula_description string, code string, unit string, "
    "business_value string, priority string, "
    "chart_config struct<chart_type: string, x_axis: string, y_axis: string, title: string>"
)
KPI_REQUIRED = ("name", "category", "formula_description", "code", "business_value", "priority",
                "chart_config.chart_type", "chart_config.title")
KPI_ALLOWED = {
    "priority": ("high", "medium", "low"),
    "chart_config.chart_type": ("line", "bar", "scatter", "pie", "histogram", "heatmap"),
}
COLUMN_REFERENCE = r"""df\[['"]([^'"]+)['"]\]"""


def unfence(text: Column) -> Column:
    """The text without a Markdown code fence or single back-ticks around it.

    An opening fence goes with the language word behind it, then the closing one.
    """
    bare = strip(text)
    open_, close = bare.startswith("```"), bare.endswith("```")
    inside = strip(F.regexp_replace(bare.substr(F.lit(4), F.greatest(F.length(bare) - 6, F.lit(0))), r"^\w+(?=[\s{\[])", ""))
    ticked = bare.substr(F.lit(2), F.greatest(F.length(bare) - 2, F.lit(0)))
    one = bare.startswith("`") & bare.endswith("`") & (F.length(bare) > 2)
    return F.when(open_ & close & (inside != ""), inside).when(one & ~open_, ticked).otherwise(text)


def is_json(text: Column) -> Column:
    """Is the whole text one JSON value? Parsers stop after the first value; put
    into an array and into an object, whatever follows it breaks one of them."""
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    closed = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    return F.coalesce(alone, F.lit(False)) & closed


def _field(item: Column, path: str) -> Column:
    for name in path.split("."):
        item = item.getField(name)
    return item


def check_replies(
    df: DataFrame,
    text: str,
    items: str,
    fields: str,
    required: Sequence[str],
    allowed: Mapping[str, Sequence[str]],
) -> DataFrame:
    """*df* with ``items`` (array of structs) and ``reason`` (null, json, schema).

    One item that misses a field or uses a word that is not allowed spoils the
    whole reply.
    """
    parsed = df.withColumn("__body", unfence(F.col(text))).withColumn(
        "items", F.from_json("__body", f"`{items}` array<struct<{fields}>>").getField(items)
    )

    def spoiled(item: Column) -> Column:
        tests = [_field(item, f).isNull() for f in required]
        tests += [~_field(item, f).isin(*words) for f, words in allowed.items()]
        bad = tests[0]
        for t in tests[1:]:
            bad = bad | t
        return F.coalesce(bad, F.lit(True))

    reason = (
        F.when(~is_json(F.col("__body")), F.lit("json"))
        .when(F.col("items").isNull() | F.exists("items", spoiled), F.lit("schema"))
    )
    return parsed.withColumn("reason", reason).drop("__body")


def parse_replies(df: DataFrame, text: str, kind: str = "plan") -> tuple[DataFrame, DataFrame]:
    """``(good, rejects)``: one row per proposed item, and the replies set aside."""
    shapes = {
        "plan": ("operations", PLAN_FIELDS, PLAN_REQUIRED, PLAN_ALLOWED),
        "kpi": ("kpis", KPI_FIELDS, KPI_REQUIRED, KPI_ALLOWED),
    }
    checked = check_replies(df, text, *shapes[kind])
    keys = [c for c in df.columns if c != text]
    good = checked.where("reason IS NULL").select(*keys, F.inline("items"))
    rejects = checked.where("reason IS NOT NULL").select(*keys, text, "reason")
    return good, rejects


def referenced_columns(code: Column) -> Column:
    """The columns a code text mentions as ``df['x']``."""
    return F.array_distinct(F.regexp_extract_all(code, F.lit(COLUMN_REFERENCE), F.lit(1)))


def screen_proposals(
    proposals: DataFrame, known: DataFrame, names: Column, keys: Sequence[str] = ("dataset", "id")
) -> tuple[DataFrame, DataFrame]:
    """``(kept, dropped)``: proposals whose *names* are all columns of their data set.

    *known* holds ``(dataset, column)`` rows. Both ways are equi-joins, so a
    data set with very many columns or proposals is no special case.
    """
    named = proposals.select(*keys, F.explode(names).alias("column")).distinct()
    unknown = named.join(known.select("dataset", "column").distinct(), ["dataset", "column"], "left_anti")
    kept = proposals.join(unknown.select(*keys).distinct(), list(keys), "left_anti")
    dropped = unknown.groupBy(*keys).agg(F.array_sort(F.collect_set("column")).alias("unknown_columns"))
    return kept, dropped


def usage_cost(calls: DataFrame, rates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Calls, tokens and estimated cost of a call log, in total or per *by*.

    *calls* has ``model, input_tokens, output_tokens``; *rates* has ``model,
    input_rate, output_rate`` per million tokens. A model without a rate costs
    nothing. Tokens are added up per model before rates are looked up.
    """
    per_model = calls.groupBy(*by, "model").agg(
        F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )
    # money in decimals: exact, and the same in whatever order it is added up
    rate = {k: F.coalesce(F.col(k).cast("decimal(12,6)"), F.lit(0)) for k in ("input_rate", "output_rate")}
    cost = F.col("input_tokens") * rate["input_rate"] + F.col("output_tokens") * rate["output_rate"]
    return (
        per_model.join(small_side(rates), "model", "left")
        .groupBy(*by)
        .agg(
            F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"),
            F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
            F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
            F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens")), F.lit(0)).alias("total_tokens"),
            F.round(F.coalesce(F.sum(cost) / 1_000_000, F.lit(0)), 6).cast("double").alias("estimated_cost_usd"),
        )
    )
