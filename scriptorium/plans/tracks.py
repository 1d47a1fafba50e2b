"""Queries over sentences of documents and over conversations as subtitle tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sentences as S
from ..functions import text as X
from ..operators import tracks
from .query import Query, table

KEYWORDS, TARGET = ("que", "ein", "the"), 400


def of_documents(value):
    return lambda spark, d: table(spark, d, "documents").select("doc_id", F.array_join(value(F.col("text")), "|").alias("result"))


def compact(spark: SparkSession, d: str) -> DataFrame:
    packs = table(spark, d, "documents").select("doc_id", S.compact_sentences(F.col("text"), TARGET).alias("packs"))
    return packs.select("doc_id", F.size("packs").alias("packs"), F.md5(F.array_join("packs", "\n")).alias("md5"))


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Turns as segments: a role is a track, two turns a page; the first page has no number, the second no label."""
    page = F.floor(F.col("turn") / 2).cast("int")
    at = (F.col("turn") * 10).cast("double")
    label = F.when(page == 1, "").otherwise(F.concat(F.lit("P"), (page + 1).cast("string")))
    return table(spark, d, "conversations").select("conv_id", "role", "turn", page.alias("page"), label.alias("label"), at.alias("from"), F.when(F.col("turn") > 0, at + 10).alias("to"), "text")


def page_groups(spark: SparkSession, d: str) -> DataFrame:
    out = tracks.page_groups(segments(spark, d), ["conv_id", "role"], "turn")
    return out.select("conv_id", "role", "page", "label", "place", F.size("entries").alias("entries"), F.col("entries")[0]["from"].alias("first"), F.array_max(F.transform("entries", lambda e: e["to"])).alias("last"))


def merged(spark: SparkSession, d: str) -> DataFrame:
    """Short turns are there already and flat but for the first of all, long ones come in by page."""
    rows = segments(spark, d).withColumn("long", F.length("text") > 150)
    base = rows.where("not long").withColumn("paged", F.col("turn") == 0)
    out = tracks.merged(base, rows.where("long").withColumn("paged", F.lit(True)), ["conv_id", "role"], "turn")
    return out.select("conv_id", "role", "turn", "place")


def times(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation with three chunks: under two labels, under none, under one that nothing has."""
    rows = segments(spark, d)
    label = lambda *x: F.array(*(F.lit(v) for v in x))
    kinds = F.array(F.struct(F.lit(1).alias("chunk"), label("P1", " P3 ").alias("labels")), F.struct(F.lit(2).alias("chunk"), label("", " ").alias("labels")), F.struct(F.lit(3).alias("chunk"), label("none").alias("labels")))
    chunks = rows.select("conv_id").distinct().select("conv_id", F.explode(kinds).alias("c")).select("conv_id", "c.*")
    return tracks.chunk_times(chunks, rows, "conv_id", "chunk", "labels")


def passes(text: str, pattern: str, n: int = 4) -> str:
    """SQL that puts a line feed for the middle of ``pattern``; matches may share their edges, hence several passes."""
    for _ in range(n):
        text = rf"regexp_replace({text}, '{pattern}', '\1' || chr(10) || '\2', 'g')"
    return text


DOTTED = r"([^A-Za-z0-9]|^)\.([^A-Za-z0-9]|$)"
SEGMENTS = """g AS (SELECT *, (turn // 2)::INT AS p, CASE WHEN turn // 2 = 1 THEN '' ELSE 'P' || (turn // 2 + 1) END AS label, turn * 10::DOUBLE AS f, CASE WHEN turn > 0 THEN turn * 10 + 10 END::DOUBLE AS t FROM conversations)"""


def trim(text: str) -> str:
    """SQL that strips white space of any script."""
    return rf"regexp_replace(coalesce({text}, ''), '^{X._ENDS}|{X._ENDS}$', '', 'g')"


QUERIES = {
    "q_brief_points": Query(of_documents(S.brief_points), f"""
        WITH s AS (SELECT doc_id, string_split_regex({passes(passes(X.CLEAN_SQL, DOTTED), '([^0-9])[、，,]([^0-9])')}, '[；;。！？!?\n]') AS parts FROM documents),
        p AS (SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(list_transform(parts, lambda x: {trim('x')})) AS part FROM s),
        u AS (SELECT doc_id, min(i) AS i, arg_min(part, i) AS part FROM p WHERE part <> '' GROUP BY doc_id, lower(part)),
        r AS (SELECT doc_id, i, part, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM u)
        SELECT doc_id, coalesce(string_agg(part, '|' ORDER BY i) FILTER (n <= 4), '') AS result FROM documents LEFT JOIN r USING (doc_id) GROUP BY doc_id"""),
    "q_keyword_sentences": Query(of_documents(lambda t: S.keyword_sentences(t, KEYWORDS)), f"""
        WITH s AS (SELECT doc_id, string_split_regex({passes("coalesce(text, '')", DOTTED)}, '[。！？!?\n]') AS parts FROM documents),
        p AS (SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS text FROM s),
        c AS (SELECT doc_id, i, {X.CLEAN_SQL} AS part FROM p),
        k AS (SELECT doc_id, i, CASE WHEN length(part) > 140 THEN rtrim(left(part, 139)) || '…' ELSE part END AS part FROM c),
        h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM k WHERE part <> '' AND ({' OR '.join(f"contains(lower(part), '{k}')" for k in KEYWORDS)})),
        u AS (SELECT doc_id, min(i) AS i, arg_min(part, i) AS part FROM h WHERE n <= 6 GROUP BY doc_id, lower(part))
        SELECT doc_id, coalesce(string_agg(part, '|' ORDER BY i), '') AS result FROM documents LEFT JOIN u USING (doc_id) GROUP BY doc_id"""),
    "q_compact_sentences": Query(compact, f"""
        WITH RECURSIVE s AS (SELECT doc_id, string_split(regexp_replace({X.CLEAN_SQL}, '([。！？!?；;])', '\\1' || chr(10), 'g'), chr(10)) AS parts FROM documents),
        p AS (SELECT doc_id, generate_subscripts(parts, 1) AS k, unnest(list_transform(parts, lambda x: {trim('x')})) AS part FROM s),
        u AS (SELECT doc_id, part, length(part) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i FROM p WHERE part <> ''),
        f AS (SELECT doc_id, i, 1 AS pack, n AS held FROM u WHERE i = 1
              UNION ALL SELECT u.doc_id, u.i, f.pack + (f.held + u.n > {TARGET})::INT, CASE WHEN f.held + u.n > {TARGET} THEN u.n ELSE f.held + u.n END FROM f JOIN u ON u.doc_id = f.doc_id AND u.i = f.i + 1),
        g AS (SELECT doc_id, pack, string_agg(part, ' ' ORDER BY i) AS text FROM f JOIN u USING (doc_id, i) GROUP BY doc_id, pack)
        SELECT doc_id, count(pack)::INT AS packs, md5(coalesce(string_agg(g.text, chr(10) ORDER BY pack), '')) AS md5 FROM documents LEFT JOIN g USING (doc_id) GROUP BY doc_id"""),
    "q_page_groups": Query(page_groups, f"""
        WITH {SEGMENTS}, r AS (SELECT conv_id, role, turn, greatest(p, 1) AS page, CASE WHEN label = '' THEN 'P' || greatest(p, 1) ELSE label END AS label, f, coalesce(t, 0) AS t FROM g WHERE {trim('text')} <> ''),
        o AS (SELECT conv_id, role, page, label, min(turn) AS turn, count(*)::INT AS entries, min(f) AS first, max(t) AS last FROM r GROUP BY ALL)
        SELECT conv_id, role, page, label, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn)::INT AS place, entries, first, last FROM o"""),
    "q_merged_tracks": Query(merged, f"""
        WITH {SEGMENTS}, r AS (SELECT conv_id, role, turn, (length(text) > 150)::INT AS late, length(text) > 150 OR turn = 0 AS paged, CASE WHEN p = 0 THEN 1 ELSE p END AS page FROM g WHERE text IS NOT NULL),
        m AS (SELECT *, bool_or(paged) OVER (PARTITION BY conv_id, role) AS by_page FROM r)
        SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY CASE WHEN paged THEN page ELSE 0 END, late, turn)::INT AS place FROM m WHERE paged OR NOT by_page"""),
    "q_chunk_times": Query(times, f"""
        WITH {SEGMENTS} SELECT conv_id, 1 AS chunk, min(f) FILTER (label IN ('P1', 'P3')) AS "from", max(coalesce(t, 0)) FILTER (label IN ('P1', 'P3')) AS "to" FROM g GROUP BY conv_id
        UNION ALL SELECT conv_id, 2, min(f), max(coalesce(t, 0)) FROM g GROUP BY conv_id UNION ALL SELECT DISTINCT conv_id, 3, NULL::DOUBLE, NULL::DOUBLE FROM g"""),
}
