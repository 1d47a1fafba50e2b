"""Queries over document texts.  Literal rows with CJK text join the documents, which have none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from .query import Query, quoted, table, values

LITERALS = [
    (-1, "大家好，请点赞投币关注，三连"), (-2, "大家好 " + "课" * 300), (-3, "关注这个课程"), (-4, "打开终端，点击安装，输入 API key 并运行"),
    (-5, "报错 权限 超时 怎么排查"), (-6, "2001年2002年 12.5% 3月4日 和 1999 12万美元 3亿人 2001年"), (-7, "概念 原理 python 版本"),
    (-8, "[00:10-00:20] a [00:20-01:02:03] b [00:10-00:20] c"), (-9, None), (-10, "嗯，今天 天气好。\n今天\n\n今天\nHello . World"), (-11, "A\n\nA\r\nB\n\n\nB\nC"),
    (-12, "㐀㐁㒰 一鿿"), (-13, "." * 25), (-14, "-" * 50 + " 你好"),
]
TEXTS = f"(SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM {values(LITERALS, 'doc_id, text')})"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame(LITERALS, "doc_id long, text string")
    return table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(extra)


def per_text(column):
    return lambda spark, d: texts(spark, d).select("doc_id", column(F.col("text")).alias("result"))


def hits_sql(keywords: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains(lower(coalesce(text, '')), {quoted(k)})::INT" for k in keywords) + ")"


CLEAN = X.CLEAN_SQL
NOISE = f"CASE WHEN {hits_sql(X.NOISE)} >= 3 OR ({hits_sql(X.NOISE)} > 0 AND length({CLEAN}) < 260) THEN 'high' WHEN {hits_sql(X.NOISE)} > 0 THEN 'medium' ELSE 'low' END"
BEST = f"greatest({', '.join(hits_sql(k) for k in X.ROLES.values())})"
ROLE = f"CASE WHEN {BEST} = 0 THEN 'concept_explain' " + " ".join(f"WHEN {hits_sql(k)} = {BEST} THEN '{r}'" for r, k in X.ROLES.items()) + " END"


def of_texts(expr: str) -> str:
    return f"SELECT doc_id, {expr} AS result FROM {TEXTS}"


def joined(column):
    """Arrays are compared as joined strings."""
    return lambda text: F.array_join(column(text), "|")


def noise_profile(spark: SparkSession, d: str) -> DataFrame:
    plain = table(spark, d, "documents").select("source", "text", X.normalize_whitespace(F.col("text")).alias("plain"))
    docs = plain.select("source", X.noise_level(F.col("text"), F.col("plain")).alias("noise"), F.length("plain").alias("n"))
    return docs.groupBy("source", "noise").agg(F.count("*").alias("docs"), F.sum("n").cast("long").alias("chars"), F.max("n").cast("long").alias("longest"))


def teaching_scores(spark: SparkSession, d: str) -> DataFrame:
    return X.profiled(texts(spark, d), "text").select("doc_id", X.scored(F.col("size"), F.col("role"), F.col("noise")).alias("result"))


def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    """Share of the text that cleaning keeps, critical terms lost, and the verdict, for labelled documents."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    out = X.rule_clean(F.col("text"))
    lost = F.size(X.missing_terms(X.numeric_terms(F.col("text")), F.col("cleaned")))
    rows = docs.withColumn("cleaned", out).select("doc_id", "quality", F.when(F.length("text") > 0, F.round(F.length("cleaned") / F.length("text"), 4)).otherwise(0.0).alias("ratio"), lost.alias("lost"))
    return rows.withColumn("ok", (F.col("ratio") >= 0.55) & (F.col("lost") <= 0)).groupBy("quality", "ok").agg(F.count("*").alias("docs"), F.sum("lost").cast("long").alias("lost"))


def decision(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    issues = (1 - F.col("quality")) + F.col("toxic")
    level = N.importance(F.length("text"), issues)
    return docs.select("doc_id", level.alias("importance"), ((F.length("text") > 0) & (level >= 3) & (issues <= 1)).alias("worth"))


def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    """Token to documents: how many and the first, for tokens of two letters or more."""
    words = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0)))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def term_index(spark: SparkSession, d: str) -> DataFrame:
    """The 160 terms in most documents, with the number of sources, and whether they are sensitive to versions."""
    words = table(spark, d, "documents").select("doc_id", "source", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,32}"), F.lit(0)))).alias("term"))
    parts = words.groupBy("term", "source").agg(F.count("*").alias("docs"))  # two levels, so that a term's documents never meet in one task
    terms = parts.groupBy("term").agg(F.count("*").alias("sources"), F.sum("docs").alias("docs")).orderBy(F.desc("docs"), F.desc("term")).limit(160)
    verify = F.exists(F.array(*map(F.lit, X.VERSION_TERMS)), lambda k: F.contains(F.col("term"), k))
    return terms.withColumn("needs_verification", verify)


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    key = F.concat_ws("|", F.coalesce(F.nullif(F.trim("lang"), F.lit("")), F.lit("und")), F.coalesce("source", F.lit("default")), F.sha1("text"))
    return docs.select("doc_id", F.sha1("text").alias("sha1"), F.left(F.sha1(F.concat_ws(":", "source", F.col("doc_id").cast("string"))), F.lit(16)).alias("record_id"), key.alias("cache_key"))


def language_pick(spark: SparkSession, d: str) -> DataFrame:
    """Per source one language: German if present, else French, else the first by name."""
    seen = table(spark, d, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("first_doc"))
    rank = F.when(F.col("lang") == "de", 0).when(F.col("lang") == "fr", 1).otherwise(2)
    best = F.min(F.struct(rank.alias("r"), F.col("lang").alias("lang"), F.col("first_doc").alias("first_doc"))).alias("b")
    return seen.groupBy("source").agg(best).select("source", "b.lang", "b.first_doc")


def duplicate_lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents that lose lines when a line equal to the last non-blank one is dropped."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: X.strip(x))
    full = F.filter(lines, lambda x: x != "")
    same = F.size(F.filter(F.col("full"), lambda x, i: (i > 0) & (x == F.get("full", i - 1))))
    return texts(spark, d).select("doc_id", F.size(lines).alias("lines"), full.alias("full")).select("doc_id", "lines", same.alias("dropped")).where("dropped > 0")


def url_parts(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", F.lower(F.regexp_extract(url, "^https?://([^/?#]+)", 1)).alias("host"), F.regexp_extract(url, r"/(\d+)(?:\.html)?(?:[?#]|$)", 1).alias("number"), F.regexp_replace(url, "[?#].*$", "").alias("plain"))


def html_text(spark: SparkSession, d: str) -> DataFrame:
    body = F.regexp_replace(F.col("html"), "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    plain = F.trim(F.regexp_replace(F.regexp_replace(body, "(?s)<[^>]+>", " "), r"\s+", " "))
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"), F.length(plain).alias("n"), F.left(plain, F.lit(220)).alias("preview"))


def gates(spark: SparkSession, d: str) -> DataFrame:
    """First failing gate of each labelled document, in order."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    reason = (
        F.when(F.col("quality").isNull(), "not_fresh").when(F.col("toxic") == 1, "forbidden").when(F.col("quality") == 0, "quality")
        .when(F.length(F.trim("text")) < 120, "no_body").otherwise("sent")
    )
    return docs.groupBy(reason.alias("reason")).agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


QUERIES = {
    "q_doc_noise_profile": Query(noise_profile, f"SELECT source, {NOISE} AS noise, count(*) AS docs, sum(length({CLEAN}))::BIGINT AS chars, max(length({CLEAN}))::BIGINT AS longest FROM documents GROUP BY 1, 2"),
    "q_noise_level": Query(per_text(X.noise_level), of_texts(NOISE)),
    "q_noise_reasons": Query(per_text(joined(X.noise_reasons)), of_texts(f"coalesce(array_to_string(list_slice(list_filter([{', '.join(map(quoted, X.NOISE))}], lambda k: contains(lower(coalesce(text, '')), k)), 1, 5), '|'), '')")),
    "q_role_classify": Query(per_text(X.role), of_texts(ROLE)),
    "q_teaching_score": Query(teaching_scores, of_texts(f"greatest(1, least(5, 1 + least(3, length({CLEAN}) // 900) + (({ROLE}) IN ('operation_steps', 'tool_config', 'troubleshooting', 'case_analysis', 'exam_training'))::INT - CASE {NOISE} WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END))::INT")),
    "q_whitespace_normalise": Query(per_text(lambda t: F.md5(X.normalize_whitespace(t))), of_texts(f"md5({CLEAN})")),
    "q_token_estimate": Query(
        lambda s, d: texts(s, d).select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"), X.block_tokens(F.col("text")).alias("block_tokens")),
        f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM {TEXTS}),
            c AS (SELECT doc_id, length(text) AS n, length(text) - length(regexp_replace(text, '[\\x{{3400}}-\\x{{9fff}}]', '', 'g')) AS cjk, len(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS w,
                         length(regexp_replace(regexp_replace(text, '[\\x{{3400}}-\\x{{9fff}}]', '', 'g'), '[A-Za-z0-9_]+', '', 'g')) AS other FROM t)
            SELECT doc_id, greatest(1, ceil(cjk * 0.72::DOUBLE + w * 1.15::DOUBLE + other * 0.28::DOUBLE))::BIGINT AS tokens, greatest(1, (n * 10 + 16) // 17)::BIGINT AS block_tokens FROM c""",
    ),
    "q_time_markers": Query(per_text(joined(X.time_markers)), f"""
        WITH m AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\\[(?:\\d{{1,2}}:)?\\d{{2}}:\\d{{2}}-(?:\\d{{1,2}}:)?\\d{{2}}:\\d{{2}}\\]') AS a FROM {TEXTS})
        SELECT doc_id, coalesce(array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), '|'), '') AS result FROM m"""),
    "q_numeric_terms": Query(per_text(joined(X.numeric_terms))),
    "q_rule_clean_lines": Query(per_text(X.rule_clean)),
    "q_slug": Query(per_text(lambda t: F.concat_ws("/", X.slug(t), X.file_name(t))), of_texts(
        "concat_ws('/', left(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 48), left(regexp_replace(coalesce(text, ''), '[\\\\/:*?\"<>|]', '_', 'g'), 80))")),
    "q_escape_html": Query(per_text(lambda t: F.md5(X.escape_html(t))), of_texts("""md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;'))""")),
    "q_quality_gate": Query(quality_gate),
    "q_decision_draft": Query(decision, """
        WITH t AS (SELECT doc_id, length(text) AS n, (1 - quality) + toxic AS issues FROM documents JOIN labels USING (doc_id)),
             i AS (SELECT *, greatest(1, least(5, round(n / 12000)::INT + 2 - least(issues, 2)))::INT AS importance FROM t)
        SELECT doc_id, importance, n > 0 AND importance >= 3 AND issues <= 1 AS worth FROM i"""),
    "q_inverted_index": Query(inverted_index, """
        WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{2,}'))) AS token FROM documents)
        SELECT token, count(*) AS docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM w GROUP BY token"""),
    "q_term_normalization": Query(term_index, f"""
        WITH w AS (SELECT doc_id, source, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{{3,32}}'))) AS term FROM documents)
        SELECT term, count(DISTINCT source) AS sources, count(*) AS docs, list_bool_or(list_transform([{', '.join(map(quoted, X.VERSION_TERMS))}], lambda k: contains(term, k))) AS needs_verification
        FROM w GROUP BY term ORDER BY docs DESC, term DESC LIMIT 160"""),
    "q_content_hash": Query(content_hash, """
        SELECT doc_id, sha1(text) AS sha1, left(sha1(source || ':' || doc_id), 16) AS record_id,
               concat_ws('|', coalesce(nullif(trim(lang), ''), 'und'), coalesce(source, 'default'), sha1(text)) AS cache_key FROM documents"""),
    "q_language_pick": Query(language_pick, """
        WITH s AS (SELECT source, lang, min(doc_id) AS first_doc FROM documents GROUP BY ALL)
        SELECT source, lang, first_doc FROM s
        QUALIFY row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'de' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END, lang, first_doc) = 1"""),
    "q_duplicate_lines": Query(duplicate_lines, f"""
        WITH l AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^{X._ENDS}|{X._ENDS}$', '', 'g')) AS a FROM {TEXTS}),
             f AS (SELECT doc_id, len(a)::INT AS lines, list_filter(a, lambda x: x <> '') AS a FROM l),
             c AS (SELECT doc_id, lines, len(list_filter(a, lambda x, i: i > 1 AND x = a[i - 1]))::INT AS dropped FROM f)
        SELECT * FROM c WHERE dropped > 0"""),
    "q_url_id_extract": Query(url_parts, """
        SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, regexp_extract(url, '/(\\d+)(?:\\.html)?(?:[?#]|$)', 1) AS number, regexp_replace(url, '[?#].*$', '') AS plain FROM pages"""),
    "q_html_preview": Query(html_text, """
        WITH p AS (SELECT page_id, html, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM pages)
        SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, length(t)::INT AS n, left(t, 220) AS preview FROM p"""),
    "q_gate_reason": Query(gates, """
        SELECT CASE WHEN quality IS NULL THEN 'not_fresh' WHEN toxic = 1 THEN 'forbidden' WHEN quality = 0 THEN 'quality' WHEN length(trim(text)) < 120 THEN 'no_body' ELSE 'sent' END AS reason,
               count(*) AS docs, min(doc_id) AS first_doc FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"""),
}
