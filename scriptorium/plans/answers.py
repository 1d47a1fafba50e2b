"""Queries over answers of models: event properties within answers of several shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as A
from .query import Query, quoted, table

#: Parts of an answer that come from the row: small numbers, a level and the properties themselves.
K3, K7, LEVEL, PROPS = ("k3",), ("k7",), ("level",), ("p",)
SHAPES = (
    ('```json\n{"worthEmail": true, "importance": ', K7, ', "reason": "r", "tags": [', PROPS, "]}\n```"),
    ('Here: {"worthEmail": false, "importance": 2.5, "reason": ', K3, ', "tags": []} Done.'),
    ('<think>{"a": 1}</think> {"worthEmail": true, "importance": ', K7, ', "reason": "x", "tags": [1]}'),
    ('["a b", {"time": "", "timestamp": "1:0', K3, '", "label": "T", "content": 5}, "A  B", null, ', K3, ', {"x": 1}, [', K3, "]]"),
    ('{"notes": ["n', K7, '", "N', K3, '"], "items": ["i"], "facts": "no"}'),
    ('{"ok": tru', PROPS),
    ('{"ok": false, "riskLevel": "', LEVEL, '", "issues": [], "missingCriticalTerms": [', PROPS, '], "reason": "b"}'),
    (K3,),
    ('{"b": "two", "a": "one ', K7, '", "c": false}'),
)
LEVELS = ("low", "medium", "high", "none")


def answers(spark: SparkSession, d: str) -> DataFrame:
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0))
    rows = table(spark, d, "events").select("event_id", F.coalesce("props", F.lit("null")).alias("p"), (k % 3).cast("string").alias("k3"), (k % 7).cast("string").alias("k7"), F.element_at(F.array(*map(F.lit, LEVELS)), (k % 4 + 1).cast("int")).alias("level"))
    text = F.lit(None).cast("string")
    for i, parts in enumerate(SHAPES):
        text = F.when(F.col("event_id") % len(SHAPES) == i, F.concat(*(F.col(x[0]) if isinstance(x, tuple) else F.lit(x) for x in parts))).otherwise(text)
    return rows.select("event_id", text.alias("text"))


_K = "coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0)"
ANSWERS = f"""a AS MATERIALIZED (SELECT event_id, CASE event_id % {len(SHAPES)} {' '.join(f"WHEN {i} THEN {' || '.join(x[0] if isinstance(x, tuple) else quoted(x) for x in parts)}" for i, parts in enumerate(SHAPES))} END AS text
    FROM (SELECT event_id, coalesce(props, 'null') AS p, ({_K} % 3)::VARCHAR AS k3, ({_K} % 7)::VARCHAR AS k7, [{', '.join(map(quoted, LEVELS))}][{_K} % 4 + 1] AS level FROM events))"""


def answer_items(spark: SparkSession, d: str) -> DataFrame:
    docs = answers(spark, d).select("event_id", A.json_document(F.col("text")).alias("doc"))
    form = F.when(A.kind(F.col("doc"), "raw") != "", "raw").when(A.kind(F.col("doc"), "items") != "", "items").otherwise("object")
    return docs.select("event_id", form.alias("form"), F.array_join(A.items(F.col("doc")), "|").alias("items"))


def answer_checks(spark: SparkSession, d: str) -> DataFrame:
    found = answers(spark, d).select("event_id", A.local_answer(F.col("text")).alias("a"))
    json = F.col("a.json")
    return found.select("event_id", json.isNotNull().alias("parsed"), F.col("a.cleaned").alias("cleaned"), A.is_decision(json).alias("decision"), A.is_quality(json).alias("quality"))


def _first(names: tuple[str, ...]) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN json_extract(x, '$.{n}')::VARCHAR NOT IN ({', '.join(map(quoted, A._NOTHING))}) THEN json_extract_string(x, '$.{n}') END" for n in names) + ", '')"


_KNOWN = " || ".join(f"CASE WHEN json_type(doc, '$.{n}') = 'ARRAY' THEN json_extract(doc, '$.{n}[*]') ELSE []::JSON[] END" for n in A.LISTS)
_BRACES = r"regexp_extract(plain, '(?s)\{.*\}')"
QUERIES = {
    "q_answer_items": Query(answer_items, f"""
        WITH {ANSWERS}, f AS (SELECT event_id, CASE WHEN regexp_full_match(text, '(?is)```(?:json)?\\s*(.*?)\\s*```') THEN regexp_extract(text, '(?is)```(?:json)?\\s*(.*?)\\s*```', 1) ELSE text END AS plain FROM a),
        v AS (SELECT event_id, plain, CASE WHEN json_valid(plain) THEN plain WHEN json_valid({_BRACES}) THEN {_BRACES} END AS found FROM f),
        d AS (SELECT event_id, CASE WHEN found IS NULL THEN json_object('raw', plain) WHEN json_type(found) <> 'OBJECT' THEN ('{{"items":' || found || '}}')::JSON ELSE found::JSON END AS doc FROM v),
        l AS (SELECT event_id, doc, {_KNOWN} AS known FROM d),
        c AS (SELECT event_id, doc, CASE WHEN len(known) > 0 THEN known ELSE [json_extract(doc, '$.' || n) FOR n IN list_sort(json_keys(doc))] END AS found FROM l),
        u AS (SELECT event_id, unnest(found) AS x, generate_subscripts(found, 1) AS spot FROM c),
        t AS (SELECT event_id, spot, trim(regexp_replace(CASE json_type(x) WHEN 'OBJECT' THEN concat_ws(' ', {', '.join(f"nullif(trim({_first(names)}), '')" for names in A.PARTS)})
              WHEN 'BOOLEAN' THEN upper(left(x::VARCHAR, 1)) || substr(x::VARCHAR, 2) WHEN 'NULL' THEN '' ELSE json_extract_string(x, '$') END, '[ \\t]+', ' ', 'g')) AS item FROM u),
        o AS (SELECT event_id, min(spot) AS spot, arg_min(item, spot) AS item FROM t WHERE item <> '' GROUP BY event_id, lower(regexp_replace(item, '\\s+', '', 'g'))),
        s AS (SELECT event_id, string_agg(item, '|' ORDER BY spot) AS items FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY spot) AS place FROM o) WHERE place <= 8 GROUP BY event_id)
        SELECT event_id, CASE WHEN json_type(doc, '$.raw') IS NOT NULL THEN 'raw' WHEN json_type(doc, '$.items') IS NOT NULL THEN 'items' ELSE 'object' END AS form, coalesce(items, '') AS items FROM d LEFT JOIN s USING (event_id)"""),
    "q_answer_checks": Query(answer_checks, f"""
        WITH {ANSWERS}, f AS (SELECT event_id, trim(regexp_replace(text, '(?is)<think\\b[^>]*>.*?</think>', '', 'g')) AS plain FROM a),
        v AS (SELECT event_id, CASE WHEN NOT json_valid(plain) AND json_valid({_BRACES}) THEN {_BRACES} ELSE plain END AS cleaned FROM f),
        j AS (SELECT event_id, cleaned, json_valid(cleaned) AS parsed, CASE WHEN json_valid(cleaned) THEN cleaned::JSON END AS v FROM v)
        SELECT event_id, parsed, cleaned,
               coalesce(json_type(v) = 'OBJECT' AND json_type(v, '$.worthEmail') = 'BOOLEAN' AND json_type(v, '$.importance') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND TRY_CAST(json_extract_string(v, '$.importance') AS DOUBLE) BETWEEN 1 AND 5
                        AND json_type(v, '$.reason') = 'VARCHAR' AND json_type(v, '$.tags') = 'ARRAY', false) AS decision,
               coalesce(json_type(v) = 'OBJECT' AND json_type(v, '$.ok') = 'BOOLEAN' AND json_extract_string(v, '$.riskLevel') IN ({', '.join(map(quoted, A.RISKS))}) AND json_type(v, '$.issues') = 'ARRAY'
                        AND json_type(v, '$.missingCriticalTerms') = 'ARRAY' AND json_type(v, '$.reason') = 'VARCHAR', false) AS quality FROM j"""),
}
