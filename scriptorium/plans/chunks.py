"""Queries over raw sources, their units and chunks, and transcripts without times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import segments as G
from ..functions import text as X
from ..operators import chunking, units
from .packages import MOST, OVERLAP, QUERIES as PACKAGES, TARGET
from .query import Query, table, values
from .texts import TEXTS, texts

CHUNK_RANGES = PACKAGES["q_chunk_plan"].sql
TOKENS = "greatest(1, ceil((length({t}) - length(regexp_replace({t}, '[\\x{{3400}}-\\x{{9fff}}]', '', 'g'))) * 0.72::DOUBLE + len(regexp_extract_all({t}, '[A-Za-z0-9_]+')) * 1.15::DOUBLE + length(regexp_replace(regexp_replace({t}, '[\\x{{3400}}-\\x{{9fff}}]', '', 'g'), '[A-Za-z0-9_]+', '', 'g')) * 0.28::DOUBLE))::BIGINT"


def built_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Turns as units of ten seconds, six under a label; every seventh has no times."""
    at = F.when(F.col("turn") % 7 != 6, (F.col("turn") * 10).cast("double"))
    label, tokens = F.floor(F.col("turn") / 6).cast("string"), F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4)
    rows = table(spark, d, "conversations").select("conv_id", "turn", label.alias("label"), "text", tokens.alias("tokens"), at.alias("from"), (at + 10).alias("to"))
    out = chunking.build_chunks(rows, ["conv_id"], ["turn"], "label", "text", "tokens", "from", "to", TARGET, MOST, OVERLAP)
    return out.select("conv_id", "chunk", F.sha1("text").alias("text_sha1"), F.array_join("labels", "|").alias("labels"), "start", "end", "units", "tokens")


def units_of_sources(spark: SparkSession, d: str) -> DataFrame:
    """Documents as raw sources in turn: a text, an object with a text, a list of tracks, and tracks with page segments."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), r"[.\n]"), lambda x: X.strip(x) != "")
    entry = F.transform(lines, lambda x, i: F.struct(x.alias("content"), i.cast("string").alias("from"), (i + 1).cast("string").alias("to")))
    k = F.col("doc_id") % 5
    # a column of its own, so that the lines are made once and only where they are used
    rows = table(spark, d, "documents").withColumn("entry", F.when(k.isin(2, 3), entry))
    entry = F.col("entry")
    tracks = F.array(F.struct(F.col("lang"), entry.alias("entries")))
    paged = F.array(F.struct(F.lit("x").alias("lang"), entry.alias("entries"), F.array(F.struct(F.lit(" P1 a ").alias("label"), F.slice(entry, 1, 3).alias("entries")), F.struct(F.lit("").alias("label"), F.slice(entry, 4, 9).alias("entries"))).alias("page_segments")))
    shape = (
        F.when(k == 0, F.to_json(F.array("text"))).when(k == 1, F.to_json(F.struct("text"))).when(k == 2, F.to_json(tracks))
        .when(k == 3, F.to_json(F.struct(paged.alias("subtitles"), F.lit("unread").alias("text")))).otherwise("7")
    )
    # a JSON string is what stands between the brackets of a list of one
    raw = F.when(k == 0, F.expr("substring(s, 2, length(s) - 2)")).otherwise(F.col("s"))
    sources = rows.withColumn("s", shape).select("doc_id", raw.alias("source"))
    out = units.source_units(sources, "doc_id", "source", 200)
    return out.groupBy("doc_id", "label").agg(F.count("*").alias("units"), F.sum("tokens").alias("tokens"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum(F.length("text")).alias("chars"))


UNITS = rf"""
    WITH RECURSIVE d AS (SELECT doc_id, doc_id % 5 AS k, lang, text FROM documents),
    p AS (SELECT doc_id, {X.CLEAN_SQL} AS text FROM d WHERE k IN (0, 1) AND text IS NOT NULL),
    pieces AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([。！？!?；;])\s*', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^{X._ENDS}|{X._ENDS}$', '', 'g')), lambda x: x <> '') AS a FROM p),
    lines AS (SELECT doc_id, k, lang, list_filter(string_split_regex(coalesce(text, ''), '[.\n]'), lambda x: regexp_replace(x, '^{X._ENDS}|{X._ENDS}$', '', 'g') <> '') AS a FROM d WHERE k IN (2, 3)),
    parts AS (SELECT doc_id, 0 AS seg, '原始文本' AS label, unnest(a) AS t, generate_subscripts(a, 1) AS i, NULL::DOUBLE AS f FROM pieces
              UNION ALL SELECT doc_id, 0, coalesce(nullif(lang, ''), '字幕内容'), unnest(a), generate_subscripts(a, 1), generate_subscripts(a, 1)::DOUBLE - 1 FROM lines WHERE k = 2
              UNION ALL SELECT doc_id, 1, 'P1 a', unnest(a[1:3]), generate_subscripts(a[1:3], 1), generate_subscripts(a[1:3], 1)::DOUBLE - 1 FROM lines WHERE k = 3
              UNION ALL SELECT doc_id, 2, '未命名分段', unnest(a[4:12]), generate_subscripts(a[4:12], 1), generate_subscripts(a[4:12], 1)::DOUBLE + 2 FROM lines WHERE k = 3),
    s AS MATERIALIZED (SELECT doc_id, seg, label, regexp_replace(t, '^{X._ENDS}|{X._ENDS}$', '', 'g') AS t, f, row_number() OVER (PARTITION BY doc_id, seg ORDER BY i) AS i FROM parts),
    g AS (SELECT doc_id, seg, i, 1 AS pack, length(t) AS held FROM s WHERE i = 1
          UNION ALL SELECT s.doc_id, s.seg, s.i, g.pack + (g.held + length(s.t) > 200)::INT, CASE WHEN g.held + length(s.t) > 200 THEN length(s.t) ELSE g.held + length(s.t) END FROM g JOIN s ON s.doc_id = g.doc_id AND s.seg = g.seg AND s.i = g.i + 1),
    u AS (SELECT s.doc_id, seg, label, regexp_replace(string_agg(t, ' ' ORDER BY i), '[ \t]+', ' ', 'g') AS text, min(f) AS start, max(f + 1) AS fin FROM s JOIN g USING (doc_id, seg, i) GROUP BY s.doc_id, seg, label, pack)
    SELECT doc_id, label, count(*) AS units, sum({TOKENS.format(t='text')})::BIGINT AS tokens, min(start) AS start, max(fin) AS "end", sum(length(text))::BIGINT AS chars FROM u GROUP BY doc_id, label"""

LONG = [(-50, "没有标点的转写文本" * 40), (-51, "a" * 250 + " " + "b" * 95 + "，" + "c" * 40), (-52, "短。"), (-53, " \n　"), (-54, "一句！二句？三句；" * 30 + "，　尾")]


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a transcript: its segments, numbered."""
    rows = texts(spark, d).unionByName(spark.createDataFrame(LONG, "doc_id long, text string"))
    return rows.select("doc_id", F.posexplode(G.transcript_segments(F.col("text"))).alias("n", "s")).select("doc_id", (F.col("n") + 1).alias("n"), F.sha1("s").alias("sha1"), F.length("s").alias("chars"))


_PLAIN = rf"regexp_replace(regexp_replace(coalesce(text, ''), '[\s\x{{b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'), '^ | $', '', 'g')"
SEGMENTS = rf"""
    WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, {_PLAIN} AS text FROM (SELECT * FROM {TEXTS} UNION ALL SELECT * FROM {values(LONG, 'doc_id, text')})),
    r AS MATERIALIZED (SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([。！？!?；;])', '\1' || chr(1), 'g'), '， +', '，' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS a FROM t WHERE text <> ''),
    c AS (SELECT doc_id, text, 0 AS pos, NULL::VARCHAR AS part, 0 AS i FROM r WHERE len(a) <= 1
          UNION ALL
          SELECT doc_id, text, pos + n, trim(substr(text, pos + 1, n)), i + 1
          FROM (SELECT *, CASE WHEN strpos(w, chr(2)) > 0 THEN 89 + strpos(w, chr(2)) ELSE least(120, length(text) - pos) END AS n
                FROM (SELECT *, regexp_replace(substr(text, pos + 90, 31), '[，,。！？!?；;、 ]', chr(2), 'g') AS w FROM c WHERE pos < length(text)))),
    parts AS (SELECT doc_id, unnest(a) AS p, generate_subscripts(a, 1) AS i FROM r WHERE len(a) > 1 UNION ALL SELECT doc_id, part, i FROM c WHERE part <> ''),
    s AS MATERIALIZED (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM parts),
    g AS (SELECT doc_id, i, 1 AS seg, length(p) AS held FROM s WHERE i = 1
          UNION ALL
          SELECT s.doc_id, s.i, g.seg + (g.held >= 90 OR g.held + length(s.p) > 120)::INT, CASE WHEN g.held >= 90 OR g.held + length(s.p) > 120 THEN length(s.p) ELSE g.held + length(s.p) END
          FROM g JOIN s ON s.doc_id = g.doc_id AND s.i = g.i + 1)
    SELECT doc_id, seg::INT AS n, sha1(string_agg(p, '' ORDER BY i)) AS sha1, sum(length(p))::INT AS chars FROM s JOIN g USING (doc_id, i) GROUP BY doc_id, seg"""


def plain_entries(spark: SparkSession, d: str) -> DataFrame:
    """Segments of turns with times: a turn starts at ten seconds a turn and lasts its number of characters in tenths; every fourth has no length."""
    duration = F.when(F.col("turn") % 4 == 3, 0.0).otherwise(F.length("text") / 10.0)
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", G.transcript_segments(F.col("text")).alias("segments"), duration.alias("duration"))
    entries = G.timed_entries(F.col("segments"), F.length(F.coalesce("text", F.lit(""))), (F.col("turn") * 10).cast("double"), F.coalesce("duration", F.lit(0.0)))
    out = rows.select("conv_id", "turn", F.posexplode(entries).alias("n", "e"))
    return out.select("conv_id", "turn", (F.col("n") + 1).alias("n"), F.round("e.from", 6).alias("start"), F.round("e.to", 6).alias("end"), F.length("e.content").alias("chars"))


ENTRIES = SEGMENTS.split("FROM g JOIN s ON")[0].replace(f"(SELECT * FROM {TEXTS} UNION ALL SELECT * FROM {values(LONG, 'doc_id, text')})", "(SELECT conv_id * 100000 + turn AS doc_id, text FROM conversations)") + """FROM g JOIN s ON s.doc_id = g.doc_id AND s.i = g.i + 1),
    e AS (SELECT doc_id, seg, sum(length(p)) AS n FROM s JOIN g USING (doc_id, i) GROUP BY doc_id, seg),
    f AS (SELECT *, count(*) OVER w AS segs, sum(n) OVER w AS total, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e WINDOW w AS (PARTITION BY doc_id)),
    h AS (SELECT conv_id, turn, seg, n, total, before, segs, CASE WHEN turn % 4 = 3 OR length(text) = 0 THEN greatest(length(text) / 7.0::DOUBLE, segs * 4.0::DOUBLE) ELSE length(text) / 10.0::DOUBLE END AS whole FROM f JOIN conversations ON conv_id * 100000 + turn = doc_id)
    SELECT conv_id, turn, seg::INT AS n, round(turn * 10 + whole * before / total, 6) AS start,
           round(greatest(turn * 10 + CASE WHEN seg = segs THEN whole ELSE whole * (before + n) / total END, turn * 10 + whole * before / total + 0.2::DOUBLE), 6) AS "end", n::INT AS chars FROM h"""

QUERIES = {
    "q_built_chunks": Query(built_chunks, f"""
        WITH r AS ({CHUNK_RANGES}), u AS (SELECT conv_id, turn, (turn // 6)::VARCHAR AS label, coalesce(text, '') AS text, CASE WHEN turn % 7 <> 6 THEN turn * 10.0::DOUBLE END AS f, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
        c AS (SELECT r.conv_id, r.chunk, regexp_replace('## ' || any_value(label) || chr(10) || chr(10) || string_agg(text, chr(10) ORDER BY i), '^{X._ENDS}|{X._ENDS}$', '', 'g') AS text, any_value(label) AS labels, min(f) AS start, max(f + 10) AS "end", count(*)::INT AS units
              FROM r JOIN u ON u.conv_id = r.conv_id AND u.i BETWEEN r.first AND r.last GROUP BY r.conv_id, r.chunk)
        SELECT conv_id, chunk, sha1(text) AS text_sha1, labels, start, "end", units, {TOKENS.format(t='text')} AS tokens FROM c"""),
    "q_source_units": Query(units_of_sources, UNITS),
    "q_transcript_segments": Query(segments, SEGMENTS),
    "q_plain_entries": Query(plain_entries, ENTRIES),
}
