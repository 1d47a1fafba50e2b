"""Queries over part, source and concept indexes of packages of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions import text as X
from ..operators import indexes
from .query import Query, quoted, table
from .texts import NOISE, ROLE

WORDS = ("点击", "报错，注意", "关注")


def rows(spark: SparkSession, d: str) -> DataFrame:
    """Forty parts that follow each other are a package."""
    text = F.concat(F.col("p_name"), F.lit(". "), F.col("p_type"), F.lit(" (API, v2.1) "), F.element_at(F.array(*map(F.lit, WORDS)), F.col("p_size") % 3 + 1))
    return table(spark, d, "part").select(F.floor(F.col("p_partkey") / 40).alias("package"), F.col("p_partkey").alias("order"), (F.col("p_partkey") % 40).alias("place"), "p_size", text.alias("text"))


def segments(spark: SparkSession, d: str) -> DataFrame:
    page = F.floor(F.col("place") / 8).cast("int")
    return rows(spark, d).select("package", "order", page.alias("page"), F.when(page == 3, " ").otherwise(F.concat(F.lit(" S "), page.cast("string"))).alias("label"), (F.col("order") * 2.0).alias("from"), F.when(F.col("p_size") % 2 == 0, F.col("order") * 2.0 + 2).alias("to"), "text")


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Ten parts are a block, with the labels of its pages and a blank one."""
    page = F.floor(F.col("place") / 8).cast("string")
    block = F.floor(F.col("place") / 10)
    texts = F.array_sort(F.collect_list(F.struct("order", "text")))
    out = rows(spark, d).withColumn("block", block).groupBy("package", "block").agg(F.collect_set(F.concat(F.lit("S  "), page)).alias("labels"), F.array_join(F.transform(texts, lambda t: t["text"]), "\n").alias("text"))
    return out.select("package", F.format_string("b%03d", "block").alias("block_id"), F.col("block").alias("order"), F.concat("labels", F.array(F.lit(" "))).alias("labels"), "text")


def part_index(spark: SparkSession, d: str) -> DataFrame:
    out = indexes.part_index(segments(spark, d), blocks(spark, d), "package")
    text = lambda c: F.array_join(c, "|").alias(c)
    return out.select("package", "part_id", "order", "page", "label", text("block_ids"), F.col("from").alias("start"), F.col("to").alias("end"), "chars", text("terms"), text("commands"), "role", "score", "noise")


def merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    out = indexes.merge_candidates(indexes.part_index(segments(spark, d), blocks(spark, d), "package"), "package")
    return out.select("package", "merge_id", F.array_join("part_ids", "|").alias("part_ids"), F.array_join("labels", "|").alias("labels"), "role", F.size("terms").alias("terms"))


def source_index(spark: SparkSession, d: str) -> DataFrame:
    out = indexes.source_index(blocks(spark, d), "package")
    return out.select("package", "block_id", "text_sha1", "chars", "tokens", F.array_join("key_terms", "|").alias("key_terms"), F.sha1("excerpt").alias("excerpt_sha1"))


def concepts(spark: SparkSession, d: str) -> DataFrame:
    return indexes.concept_index(blocks(spark, d), "package").select("package", "concept", F.array_join("block_ids", "|").alias("block_ids"))


def critical(spark: SparkSession, d: str) -> DataFrame:
    """Critical terms of names, dates and discounts of lines."""
    text = F.concat_ws(" ", F.date_format("l_shipdate", "yyyy年"), F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%")), F.lit("新的模型 v2.x"), "l_returnflag", F.concat(F.lit("Key"), "l_linestatus"), F.concat("l_linestatus", F.lit("ey")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(T.critical_terms(text), "|").alias("terms"))


_ROWS = f"SELECT p_partkey // 40 AS package, p_partkey AS k, p_partkey % 40 AS place, p_size, p_name || '. ' || p_type || ' (API, v2.1) ' || [{', '.join(map(quoted, WORDS))}][p_size % 3 + 1] AS text FROM part"
#: Of texts without other scripts than these names are found by ASCII boundaries.
_BLOCKS = "SELECT package, place // 10 AS block, printf('b%03d', place // 10) AS block_id, string_agg(text, chr(10) ORDER BY k) AS text FROM r GROUP BY ALL"


def _terms(source: str, ids: str, limit: int) -> str:
    """CTE ``terms``: the terms of ``source`` (ids, text) as ids, a."""
    return f"""
        cand AS (SELECT {ids}, list_concat(list_filter(regexp_extract_all(text, '\\b[A-Za-z][A-Za-z0-9_.+-]{{1,31}}\\b'), lambda x: length(x) >= 3 OR regexp_matches(x, '[A-Z]')),
                   list_filter(string_split_regex(text, '[，。、“”‘’：；（）()\\[\\]【】、《》\\s/]+'), lambda x: length(x) BETWEEN 2 AND 12 AND NOT regexp_full_match(x, '\\d+(\\.\\d+)?'))) AS a FROM {source}),
        flat AS (SELECT {ids}, generate_subscripts(a, 1) AS i, trim(unnest(a), {quoted(T.MARKS)}) AS x FROM cand),
        uniq AS (SELECT {ids}, min(i) AS i, arg_min(x, i) AS x FROM flat WHERE x <> '' AND length(x) <= 32 AND NOT regexp_full_match(x, '\\d+|[A-Za-z]') AND x NOT IN ({', '.join(map(quoted, T.STOPWORDS))}) GROUP BY {ids}, lower(x)),
        nth AS (SELECT *, row_number() OVER (PARTITION BY {ids} ORDER BY i) AS n FROM uniq),
        terms AS (SELECT {ids}, list(x ORDER BY i) AS a FROM nth WHERE n <= {limit} GROUP BY {ids})"""


_PARTS = f"""
    r AS MATERIALIZED ({_ROWS}), b AS MATERIALIZED ({_BLOCKS}),
    p AS MATERIALIZED (SELECT package, place // 8 AS page, CASE WHEN place // 8 = 3 THEN '字幕' ELSE 'S ' || (place // 8) END AS label, min(k) AS first, min(k * 2)::DOUBLE AS start, max(CASE WHEN p_size % 2 = 0 THEN k * 2 + 2 ELSE 0 END)::DOUBLE AS "end", string_agg(text, ' ' ORDER BY k) AS text FROM r GROUP BY ALL),
    q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY package ORDER BY first)::INT AS nr, {NOISE} AS noise, {ROLE} AS role FROM p),
    {_terms('q', 'package, page', 18)},
    lb AS (SELECT DISTINCT package, place // 8 AS page, printf('b%03d', place // 10) AS block_id FROM r)"""
_PART_ID = "CASE WHEN page > 0 THEN printf('P%02d', page) ELSE printf('part_%03d', nr) END"

QUERIES = {
    "q_part_index": Query(part_index, f"""
        WITH {_PARTS}
        SELECT q.package, {_PART_ID} AS part_id, nr AS "order", nullif(q.page, 0)::INT AS page, label, CASE WHEN q.page = 3 THEN '' ELSE (SELECT string_agg(block_id, '|' ORDER BY block_id) FROM lb WHERE lb.package = q.package AND lb.page = q.page) END AS block_ids, start, "end", length(text)::INT AS chars,
               array_to_string(a, '|') AS terms, array_to_string(list_filter(a, lambda x: regexp_matches(x, '[A-Za-z]'))[1:10], '|') AS commands, role,
               greatest(1, least(5, 1 + least(3, length(text) // 900) + (role IN ('operation_steps', 'tool_config', 'troubleshooting', 'case_analysis', 'exam_training'))::INT - CASE noise WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END))::INT AS score, noise
        FROM q LEFT JOIN (SELECT package AS tp, page AS tg, a FROM terms) ON tp = q.package AND tg = q.page"""),
    "q_merge_candidates": Query(merge_candidates, f"""
        WITH RECURSIVE {_PARTS},
        e AS (SELECT q.package, q.page, nr, label, role, noise = 'high' AS noisy, list_transform(a, lambda x: lower(x)) AS a FROM q LEFT JOIN terms t ON t.package = q.package AND t.page = q.page),
        f AS (SELECT *, coalesce(role = lag(role) OVER w, false) AS same, coalesce(list_has_any(a, lag(a) OVER w), false) AS shared FROM e WINDOW w AS (PARTITION BY package ORDER BY nr)),
        s AS (SELECT package, nr, CASE WHEN noisy THEN 0 ELSE 1 END AS size, CASE WHEN noisy THEN 0 ELSE 1 END AS run FROM f WHERE nr = 1
              UNION ALL
              SELECT f.package, f.nr, CASE WHEN f.noisy THEN 0 WHEN s.size BETWEEN 1 AND 3 AND f.same AND (f.shared OR s.size < 3) THEN s.size + 1 ELSE 1 END,
                     CASE WHEN f.noisy THEN s.run WHEN s.size BETWEEN 1 AND 3 AND f.same AND (f.shared OR s.size < 3) THEN s.run ELSE s.run + 1 END
              FROM s JOIN f ON f.package = s.package AND f.nr = s.nr + 1),
        g AS (SELECT s.package, run, min(s.nr) AS first, string_agg({_PART_ID.replace("nr", "f.nr").replace("pf.nrintf", "printf")}, '|' ORDER BY f.nr) AS part_ids, string_agg(label, '|' ORDER BY f.nr) AS labels, any_value(role) AS role, least(12, len(list_distinct(flatten(list(a)))))::INT AS terms
              FROM s JOIN (SELECT package AS fp, page, nr, label, role, a FROM f) f ON fp = s.package AND f.nr = s.nr WHERE size > 0 GROUP BY s.package, run HAVING count(*) > 1)
        SELECT package, printf('merge_%03d', row_number() OVER (PARTITION BY package ORDER BY first)) AS merge_id, part_ids, labels, role, terms FROM g"""),
    "q_source_index": Query(source_index, f"""
        WITH r AS MATERIALIZED ({_ROWS}), b AS MATERIALIZED ({_BLOCKS}), {_terms('b', 'package, block_id', 14)}
        SELECT b.package, b.block_id, sha1(text) AS text_sha1, length(text)::INT AS chars, greatest(1, (length(text) * 10 + 16) // 17)::BIGINT AS tokens, array_to_string(a, '|') AS key_terms, sha1(left({X.CLEAN_SQL}, 700)) AS excerpt_sha1
        FROM b LEFT JOIN terms t ON t.package = b.package AND t.block_id = b.block_id"""),
    "q_concept_index": Query(concepts, f"""
        WITH r AS MATERIALIZED ({_ROWS}), b AS ({_BLOCKS}),
        s AS (SELECT package, block_id, string_split_regex(regexp_replace(regexp_replace(regexp_replace(text, '([^A-Za-z0-9])\\.([^A-Za-z0-9])', '\\1' || chr(10) || '\\2', 'g'), '([^0-9])[、，,]([^0-9])', '\\1' || chr(10) || '\\2', 'g'), '([^0-9])[、，,]([^0-9])', '\\1' || chr(10) || '\\2', 'g'), '[；;。！？!?\\n]') AS parts FROM b),
        p AS (SELECT package, block_id, generate_subscripts(parts, 1) AS i, unnest(list_transform(parts, lambda x: trim(x))) AS part FROM s),
        u AS (SELECT package, block_id, min(i) AS i, arg_min(part, i) AS part FROM p WHERE part <> '' GROUP BY package, block_id, lower(part)),
        n AS (SELECT *, row_number() OVER (PARTITION BY package, block_id ORDER BY i) AS n FROM u),
        k AS (SELECT DISTINCT package, block_id, unnest(list_filter(string_split_regex(part, '[，。、“”‘’：；（）()\\[\\]【】、《》\\s/]+'), lambda x: length(x) >= 2)[1:6]) AS concept FROM n WHERE n <= 10)
        SELECT package, concept, string_agg(block_id, '|' ORDER BY block_id) AS block_ids FROM k GROUP BY 1, 2"""),
    "q_critical_terms": Query(critical, """
        SELECT l_orderkey, l_linenumber, year(l_shipdate) || '年|' || round(l_discount * 100)::INT || '%|新的模型|v2.x|Key' || l_linestatus || '|' || l_linestatus || 'ey' AS terms FROM lineitem"""),
}
