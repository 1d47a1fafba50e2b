"""Queries over courses as trees, and over JSON of any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lessons, variants
from .query import Query, quoted, table

TITLES = ("导学", "案例", "原理", "易错点", "总结", "无")
MORE = ("阶段复盘", "复盘", "Section")


def course(spark: SparkSession, d: str) -> DataFrame:
    """Regions as courses of one root, nations as sections, suppliers as lessons; some nations and suppliers recap."""
    r, n, s = table(spark, d, "region"), table(spark, d, "nation"), table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    none = F.lit(None).cast("string")
    return (
        r.select(F.col("r_regionkey").alias("course"), F.concat(F.lit("r"), "r_regionkey").alias("id"), none.alias("parent"), F.lit("chapter").alias("kind"), F.col("r_name").alias("title"), none.alias("summary"), F.lit(1).cast("long").alias("rank"))
        .unionByName(n.select(F.col("n_regionkey").alias("course"), F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.lit("section").alias("kind"),
                              F.when(F.col("n_nationkey") % 6 == 5, pick(MORE, F.col("n_nationkey") % 3)).otherwise(F.col("n_name")).alias("title"), none.alias("summary"), (-F.col("n_nationkey")).cast("long").alias("rank")))
        .unionByName(s.select(F.col("n_regionkey").alias("course"), F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("parent"), F.when(F.col("s_nationkey") % 4 == 0, "section").otherwise("lesson").alias("kind"),
                              F.when(F.col("s_suppkey") % 17 == 0, "练习").otherwise(F.concat_ws(" ", "s_name", pick(TITLES, F.col("s_suppkey") % 6))).alias("title"), F.when(F.col("s_suppkey") % 11 == 0, "概念 与 定义").alias("summary"), F.floor(F.col("s_acctbal")).cast("long").alias("rank")))
    )


NODES = f"""
    SELECT r_regionkey AS course, 'r' || r_regionkey AS id, NULL::VARCHAR AS parent, 'chapter' AS kind, r_name AS title, NULL::VARCHAR AS summary, 1::BIGINT AS rank FROM region
    UNION ALL SELECT n_regionkey, 'n' || n_nationkey, 'r' || n_regionkey, 'section', CASE WHEN n_nationkey % 6 = 5 THEN [{', '.join(map(quoted, MORE))}][n_nationkey % 3 + 1] ELSE n_name END, NULL::VARCHAR, -n_nationkey FROM nation
    UNION ALL SELECT n_regionkey, 's' || s_suppkey, 'n' || s_nationkey, CASE WHEN s_nationkey % 4 = 0 THEN 'section' ELSE 'lesson' END,
              CASE WHEN s_suppkey % 17 = 0 THEN '练习' ELSE s_name || ' ' || [{', '.join(map(quoted, TITLES))}][s_suppkey % 6 + 1] END, CASE WHEN s_suppkey % 11 = 0 THEN '概念 与 定义' END, floor(s_acctbal)::BIGINT FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
RECAP = "(contains(title, '阶段复盘') OR contains(title, '阶段练习') OR title IN ('复盘', '练习', '回顾'))"


def preorder(spark: SparkSession, d: str) -> DataFrame:
    return lessons.flattened(course(spark, d)).withColumn("children", F.array_join("children", ","))


def links(spark: SparkSession, d: str) -> DataFrame:
    """A supplier needs the next lower one of its nation, and two of other nations."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    near = F.array(F.col("s_suppkey") - 25, F.col("s_suppkey") - 1, F.col("s_suppkey"), F.col("s_suppkey") + 7)
    return s.select(F.col("n_regionkey").alias("course"), F.concat(F.lit("s"), "s_suppkey").alias("id"), F.posexplode(F.transform(near, lambda x: F.concat(F.lit("s"), x.cast("string")))).alias("at", "needs")).select("course", "id", "needs", F.col("at").cast("long").alias("at"))


def teaching_flow(spark: SparkSession, d: str) -> DataFrame:
    return lessons.restructured(course(spark, d), links(spark, d)).withColumn("needs", F.array_join("needs", ","))


_BUCKET = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(t, {quoted(w)})' for w in words)} THEN {b}" for b, words in lessons.BUCKETS.items()) + " ELSE 3 END"


def nested(spark: SparkSession, d: str) -> DataFrame:
    """Event properties within usage records of several depths."""
    k = F.get_json_object("props", "$.k")
    number = lambda m: (F.coalesce(k.try_cast("long"), F.lit(0)) % m).cast("string")
    shape = F.col("event_id") % 5
    text = (
        F.when(shape == 0, F.format_string('{"usage": {"prompt_tokens": %s, "input_tokens": 9, "completion_tokens": 2.9}, "x": [1, [{"usage": {"total_tokens": %s}}]]}', number(50), number(3)))
        .when(shape == 1, F.format_string('[{"a": {"b": {"c": [{"output_tokens": %s}, {"input_tokens": true}]}}}, %s]', number(40), F.col("props")))
        .when(shape == 2, F.format_string('{"prompt_tokens": null, "input_tokens": 7, "completion_tokens": "5", "more": %s, "list": [%s, {"total_tokens": -%s}]}', F.col("props"), number(9), number(5)))
        .when(shape == 3, F.col("props")).otherwise(number(7))
    )
    return table(spark, d, "events").select("event_id", F.parse_json(text).alias("usage"))


def usage(spark: SparkSession, d: str) -> DataFrame:
    return variants.usage_tokens(nested(spark, d), "event_id", "usage")


_K = "coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0)"
QUERIES = {
    "q_course_preorder": Query(preorder, f"""
        WITH RECURSIVE n AS MATERIALIZED ({NODES}), k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY course, parent ORDER BY rank, id) AS place FROM n WHERE NOT {RECAP}),
        t AS (SELECT course, id, parent, 0 AS depth, [place] AS path FROM k WHERE parent IS NULL UNION ALL SELECT k.course, k.id, k.parent, depth + 1, list_append(path, place) FROM t JOIN k ON k.course = t.course AND k.parent = t.id)
        SELECT course, row_number() OVER (PARTITION BY course ORDER BY path)::INT AS position, id, parent, depth,
               coalesce((SELECT string_agg(c.id, ',' ORDER BY c.path) FROM t c WHERE c.course = t.course AND c.parent = t.id), '') AS children FROM t"""),
    "q_teaching_flow": Query(teaching_flow, f"""
        WITH RECURSIVE n AS MATERIALIZED ({NODES}), l AS (SELECT course, parent, bool_and(kind = 'lesson') AS lessons FROM n GROUP BY ALL),
        b AS (SELECT n.*, lessons, CASE WHEN lessons THEN {_BUCKET} ELSE 0 END AS bucket FROM (SELECT *, concat_ws(' ', title, summary) AS t FROM n) n LEFT JOIN l ON l.course = n.course AND l.parent = n.parent),
        k AS (SELECT course, id, parent, rank, bucket, 0 AS depth FROM b WHERE parent IS NULL
              UNION ALL SELECT b.course, b.id, b.parent, b.rank, b.bucket, depth + 1 FROM k JOIN b ON b.course = k.course AND b.parent = k.id WHERE NOT (depth = 0 AND {RECAP})),
        r AS MATERIALIZED (SELECT course, id, parent, CASE WHEN parent IS NULL THEN rank ELSE row_number() OVER w END AS rank, CASE WHEN parent IS NOT NULL THEN lag(id) OVER w END AS before FROM k WINDOW w AS (PARTITION BY course, parent ORDER BY bucket, rank, id)),
        e AS (SELECT n_regionkey AS course, 's' || s_suppkey AS id, unnest(['s' || (s_suppkey - 25), 's' || (s_suppkey - 1), 's' || s_suppkey, 's' || (s_suppkey + 7)]) AS needs, unnest([0, 1, 2, 3]) AS pos FROM supplier JOIN nation ON s_nationkey = n_nationkey),
        o AS (SELECT e.course, e.id, e.needs, e.pos FROM e JOIN r ON r.course = e.course AND r.id = e.id LEFT JOIN r f ON f.course = e.course AND f.id = e.needs WHERE e.needs <> e.id AND coalesce(f.parent <> r.parent, true)
              UNION ALL SELECT course, id, before, 99 FROM r WHERE before IS NOT NULL)
        SELECT r.course, r.id, r.parent, r.rank::BIGINT AS rank, coalesce((SELECT string_agg(needs, ',' ORDER BY pos) FROM o WHERE o.course = r.course AND o.id = r.id), '') AS needs FROM r"""),
    "q_usage_tokens": Query(usage, f"""
        WITH p AS (SELECT event_id, event_id % 5 AS s, {_K} AS k FROM events),
        u AS (SELECT event_id, CASE s WHEN 0 THEN k % 50 WHEN 1 THEN 1 ELSE 0 END AS i, CASE s WHEN 0 THEN 2 WHEN 1 THEN k % 40 ELSE 0 END AS o, CASE s WHEN 0 THEN k % 3 WHEN 2 THEN -(k % 5) ELSE 0 END AS t FROM p)
        SELECT event_id, i::BIGINT AS input_tokens, o::BIGINT AS output_tokens, (CASE WHEN t <> 0 THEN t ELSE i + o END)::BIGINT AS total_tokens FROM u"""),
}
