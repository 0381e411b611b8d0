"""Queries over catalogs of tables, tables of replies, and call logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries.tables import EVENT_CATALOG, duck, table, view
from tablecare.functions.lexicon import DOMAIN_TERMS
from tablecare.operators.catalog import plain_name, snake_names, tag_domains
from tablecare.operators.proposals import (
    check_replies, KPI_ALLOWED, KPI_FIELDS, KPI_REQUIRED, parse_replies, referenced_columns, screen_proposals, unfence,
    usage_cost,
)

# One reply per turn of a conversation: fenced, ticked, bare, cut off, or with a word that is not allowed.
PLAN_REPLIES = """
SELECT conv_id, turn, CASE
    WHEN turn % 5 = 0 THEN concat('```json', chr(10), body, chr(10), '```')
    WHEN turn % 5 = 1 THEN concat('`', body, '`')
    WHEN turn % 5 = 2 THEN replace(body, '"medium"', '"perhaps"')
    WHEN conv_id % 9 = 0 THEN concat('Sure: ', body)
    ELSE body END AS reply
FROM (SELECT conv_id, turn, concat(
    '{{"operations": [{{"id": "op_', CAST(turn AS {S}), '", "type": "fill_missing", "description": "', role,
    '", "impact": "', CAST(length(text) AS {S}), ' rows", "confidence": "', CASE WHEN turn % 2 = 0 THEN 'medium' ELSE 'high' END,
    '", "reversible": false, "code": "df[''', role, '''] = 0", "column_names": ["', role, '"]}}]}}') AS body FROM conversations)
"""
KPI_REPLIES = """
SELECT conv_id, turn, concat(
    '```{{"kpis": [{{"name": "', role, '", "category": "c", "formula_description": "f", "code": "df[''', role, '''].sum() / df[', chr(92), '"n', chr(92), '"]", ',
    '"business_value": "b", "priority": "', CASE WHEN conv_id % 4 = 0 THEN 'urgent' ELSE 'high' END,
    '", "chart_config": {{"chart_type": "', CASE WHEN turn % 3 = 0 THEN 'radar' ELSE 'bar' END, '", "title": "t"}}}}]}}```') AS reply
FROM conversations
"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, EVENT_CATALOG, "events")


def catalog_snake_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snake_names(catalog(spark, sf_dir)).select("table", "pos", "new_name")


def catalog_plain_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).select("pos", plain_name(F.col("column")).alias("plain"))


def catalog_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_domains(catalog(spark, sf_dir)).withColumn("rank", F.col("rank").cast("bigint"))


def plan_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, PLAN_REPLIES, "conversations")


def replies_unfenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_replies(spark, sf_dir).select("conv_id", "turn", F.md5(unfence(F.col("reply"))).alias("body_md5"))


def replies_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = parse_replies(plan_replies(spark, sf_dir), "reply")
    return good.select("conv_id", "turn", "id", "type", "confidence", "reversible",
                       F.col("column_names")[0].alias("first_column"))


def replies_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_replies(plan_replies(spark, sf_dir), "reply")[1].select("conv_id", "turn", "reason")


def kpi_replies_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = view(spark, sf_dir, KPI_REPLIES, "conversations")
    checked = check_replies(replies, "reply", "kpis", KPI_FIELDS, KPI_REQUIRED, KPI_ALLOWED)
    return checked.select("conv_id", "turn", "reason")


def kpi_code_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = parse_replies(view(spark, sf_dir, KPI_REPLIES, "conversations"), "reply", "kpi")
    return good.select("conv_id", "turn", F.array_join(referenced_columns(F.col("code")), ",").alias("columns"))


def _screened(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Proposals of each conversation against the roles that had spoken by its second turn."""
    talk = table(spark, sf_dir, "conversations")
    proposals = talk.select(
        F.col("conv_id").alias("dataset"), F.col("turn").alias("id"),
        F.array("role", F.when(F.col("turn") % 4 == 3, F.lit("nobody"))).alias("names"),
    ).withColumn("names", F.array_compact("names"))
    known = talk.where("turn < 2").select(F.col("conv_id").alias("dataset"), F.col("role").alias("column"))
    return screen_proposals(proposals, known, F.col("names"))


def screen_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _screened(spark, sf_dir)[0].select("dataset", "id")


def screen_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    dropped = _screened(spark, sf_dir)[1]
    return dropped.select("dataset", "id", F.array_join("unknown_columns", ",").alias("unknown_columns"))


def _usage(spark: SparkSession, sf_dir: str, by: list[str]) -> DataFrame:
    calls = table(spark, sf_dir, "conversations").selectExpr(
        "role", "CASE WHEN conv_id % 3 = 0 THEN 'large' WHEN conv_id % 3 = 1 THEN 'small' ELSE 'unlisted' END AS model",
        "CAST(length(text) AS BIGINT) AS input_tokens", "turn * 10 AS output_tokens",
    )
    rates = spark.createDataFrame([("large", 3.0, 15.0), ("small", 0.25, 1.25)],
                                  "model string, input_rate double, output_rate double")
    return usage_cost(calls, rates, by)


def usage_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usage(spark, sf_dir, [])


def usage_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usage(spark, sf_dir, ["role"])


_SNAKE = """WITH c AS ({catalog}), s AS (SELECT *, trim(regexp_replace(lower(regexp_replace(regexp_replace(trim("column"),
    '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+', '_', 'g'), '_') AS snake FROM c),
    n AS (SELECT *, CASE WHEN snake = '' THEN 'unnamed' WHEN regexp_matches(snake, '^[0-9]') THEN 'col_' || snake ELSE snake END AS name FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY "table", name ORDER BY pos) AS r FROM n)
    SELECT "table", pos, CASE WHEN r = 1 THEN name ELSE name || '_' || r END AS new_name FROM r"""
_TERMS = ", ".join(f"({i}, '{d}', '{t.replace('_', ' ')}')" for i, (d, ts) in enumerate(DOMAIN_TERMS.items()) for t in ts)
_DOMAINS = f"""WITH c AS ({duck(EVENT_CATALOG)}), n AS (SELECT DISTINCT "table", trim(regexp_replace(lower("column"), '[_\\-\\s]+', ' ', 'g')) AS name FROM c),
    w AS (SELECT "table", count(*) AS cols FROM c GROUP BY "table"), t(p, domain, term) AS (VALUES {_TERMS}),
    s AS (SELECT "table", p, domain, count(DISTINCT term) AS score FROM n JOIN t ON regexp_matches(name, '\\b' || term || '\\b') GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY "table" ORDER BY score DESC, p) AS "rank" FROM s)
    SELECT "table", "rank", domain, score, CASE WHEN score >= 4 OR score / cols >= 0.4 THEN 'high'
    WHEN score >= 2 OR score / cols >= 0.2 THEN 'medium' ELSE 'low' END AS confidence FROM r JOIN w USING ("table") WHERE "rank" <= 2"""
_BODY = """CASE WHEN regexp_matches(reply, '^```') THEN trim(regexp_replace(reply, '^```(json)?|```$', '', 'g'), chr(10))
    WHEN regexp_matches(reply, '^`.+`$') THEN reply[2:-2] ELSE reply END"""
_PLAN_BODIES = f"WITH b AS (SELECT conv_id, turn, {_BODY} AS body FROM ({duck(PLAN_REPLIES)}))"
_KPI_BODIES = f"WITH b AS (SELECT conv_id, turn, {_BODY} AS body FROM ({duck(KPI_REPLIES)}))"
_OP = "json_extract_string(body, '$.operations[0].{}')"
_REASON = f"""CASE WHEN NOT json_valid(body) THEN 'json' WHEN {_OP.format('confidence')} NOT IN ('high', 'medium', 'low') THEN 'schema' END"""
_KPI_REASON = """CASE WHEN NOT json_valid(body) THEN 'json' WHEN json_extract_string(body, '$.kpis[0].priority') <> 'high'
    OR json_extract_string(body, '$.kpis[0].chart_config.chart_type') <> 'bar' THEN 'schema' END"""
_CALLS = """WITH calls AS (SELECT role, CASE WHEN conv_id % 3 = 0 THEN 3.0 WHEN conv_id % 3 = 1 THEN 0.25 ELSE 0 END AS ri,
    CASE WHEN conv_id % 3 = 0 THEN 15.0 WHEN conv_id % 3 = 1 THEN 1.25 ELSE 0 END AS ro,
    length(text) AS i, turn * 10 AS o FROM conversations)"""
_COST = """count(*) AS calls, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, sum(i + o)::BIGINT AS total_tokens,
    round(sum(i * ri + o * ro) / 1000000, 6) AS estimated_cost_usd FROM calls"""
_UNKNOWN = """WITH p AS (SELECT conv_id, turn, unnest(CASE WHEN turn % 4 = 3 THEN [role, 'nobody'] ELSE [role] END) AS name FROM conversations),
    k AS (SELECT DISTINCT conv_id, role FROM conversations WHERE turn < 2),
    u AS (SELECT DISTINCT conv_id, turn, name FROM p WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.conv_id = p.conv_id AND k.role = p.name))"""

QUERIES = {
    "catalog_snake_names": (catalog_snake_names, _SNAKE.format(catalog=duck(EVENT_CATALOG))),
    "catalog_plain_names": (catalog_plain_names, f"""WITH c AS ({duck(EVENT_CATALOG)})
        SELECT pos, trim(regexp_replace(lower("column"), '[_\\-\\s]+', ' ', 'g')) AS plain FROM c"""),
    "catalog_domains": (catalog_domains, _DOMAINS),
    "replies_unfenced": (replies_unfenced, f"{_PLAN_BODIES} SELECT conv_id, turn, md5(body) AS body_md5 FROM b"),
    "replies_good": (replies_good, f"""{_PLAN_BODIES} SELECT conv_id, turn, {_OP.format('id')} AS id, {_OP.format('type')} AS type,
        {_OP.format('confidence')} AS confidence, false AS reversible, {_OP.format('column_names[0]')} AS first_column
        FROM b WHERE {_REASON} IS NULL"""),
    "replies_rejected": (replies_rejected, f"{_PLAN_BODIES} SELECT conv_id, turn, {_REASON} AS reason FROM b WHERE {_REASON} IS NOT NULL"),
    "replies_kpi_checked": (kpi_replies_checked, f"{_KPI_BODIES} SELECT conv_id, turn, {_KPI_REASON} AS reason FROM b"),
    "replies_kpi_columns": (kpi_code_columns, f"""{_KPI_BODIES} SELECT conv_id, turn,
        array_to_string(regexp_extract_all(json_extract_string(body, '$.kpis[0].code'), 'df\\[[''"]([^''"]+)[''"]\\]', 1), ',') AS columns
        FROM b WHERE {_KPI_REASON} IS NULL"""),
    "proposals_kept": (screen_kept, f"""{_UNKNOWN} SELECT conv_id AS dataset, turn AS id FROM conversations c
        WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.conv_id = c.conv_id AND u.turn = c.turn)"""),
    "proposals_dropped": (screen_dropped, f"""{_UNKNOWN} SELECT conv_id AS dataset, turn AS id,
        string_agg(name, ',' ORDER BY name) AS unknown_columns FROM u GROUP BY ALL"""),
    "usage_total": (usage_total, f"{_CALLS} SELECT {_COST}"),
    "usage_by_role": (usage_by_role, f"{_CALLS} SELECT role, {_COST} GROUP BY role"),
}
