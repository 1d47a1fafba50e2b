"""Queries over records kept in several places, their caches, manifests and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import checks as C
from ..functions import labels as L
from ..functions import numbers as N
from ..operators import records as R
from .inventory import CJK_N, each, of_more, replaced, stripped
from .query import Query, quoted, table

MODES, LABELS = ("auto", "force", "off", "skip", "always"), ("SenseVoice ", "本地 ", "音频转写 ", "CC 字幕 ", "")


def picked(options: tuple[str, ...], place) -> F.Column:
    return F.element_at(F.array(*map(F.lit, options)), (place % len(options) + 1).cast("int"))


def picked_sql(options: tuple[str, ...], place: str) -> str:
    return f"[{', '.join(map(quoted, options))}][({place}) % {len(options)} + 1]"


def eligibility(spark: SparkSession, d: str) -> DataFrame:
    """Which documents are summed up: a mode each, a key for most sources, a tenth of the characters as seconds."""
    route = C.summary_route(picked(MODES, F.col("doc_id")), F.col("source") != "src0", F.col("n_chars") / 5, F.col("n_chars"))
    return table(spark, d, "documents").select("doc_id", route.alias("r")).select("doc_id", "r.eligible", F.array_join("r.reasons", ",").alias("reasons"))


def source_types(spark: SparkSession, d: str) -> DataFrame:
    kind = C.source_type(F.concat(picked(LABELS, F.col("doc_id")), F.col("source")))
    return table(spark, d, "documents").groupBy("lang", kind.alias("kind")).agg(F.count("*").alias("n"))


def cleaning_accepted(spark: SparkSession, d: str) -> DataFrame:
    """Lines as cleaned chunks: markers and terms of the source, how many of them are lost, and both lengths."""
    markers, terms, lost = F.col("l_quantity").cast("int"), F.col("l_partkey") % 90, F.col("l_linenumber") - 1
    source, chars = F.floor(F.col("l_extendedprice") / 10), F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount") * 4) / 10)
    accepted = (lost <= C.tolerated(markers, 5)) & (lost <= C.tolerated(terms, 8))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(accepted).alias("accepted"), F.count_if(C.too_short(source, chars)).alias("short"), F.count("*").alias("n"))


def cleaning_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Each text against a cleaned one of another length, or one in Chinese."""
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    k = F.col("doc_id") % 8
    rows = rows.withColumn("clean", F.when(k == 7, F.repeat("text", F.lit(2))).when(k == 6, F.repeat(F.lit("字"), F.floor(F.length("text") * 0.3).cast("int"))).otherwise(F.left("text", F.floor(F.length("text") * (k + 3) / 8).cast("int"))))
    issues = C.cleaning_issues(F.length("text"), F.length("clean"), L.cjk_share(F.col("text")), L.cjk_share(F.col("clean")))
    return rows.select("doc_id", F.array_join(issues, ",").alias("issues"))


def published(spark: SparkSession, d: str) -> DataFrame:
    """The first of several fields that is a moment: epoch seconds, epoch milliseconds or ISO text."""
    at = F.floor(N.micros(F.col("o_orderdate")) / 1000).cast("long")
    k = F.col("o_orderkey")
    iso = F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fields = [
        F.when(k % 5 == 0, F.floor(at / 1000).cast("string")).when(k % 5 == 1, "soon").otherwise(""),
        F.when(k % 3 == 0, (at + 1000).cast("string")), F.when(k % 2 == 0, iso).otherwise("n/a"), F.when(k % 7 == 0, "2020-02-30"), F.when(k % 11 == 0, "0").otherwise(at.cast("string")),
    ]
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(*(N.moment(f) for f in fields)).alias("ms"))


PUBLISHED = """
    WITH o AS (SELECT o_orderkey, o_orderkey AS k, epoch_ms(o_orderdate) AS t FROM orders)
    SELECT o_orderkey, CASE WHEN k % 5 = 0 THEN t // 1000 * 1000 WHEN k % 3 = 0 THEN t + 1000 WHEN k % 2 = 0 THEN t // 1000 * 1000 WHEN k % 11 = 0 THEN NULL ELSE t END AS ms FROM o"""


def page_cache(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as transcript caches, every other one in the older nested shape; where each page stands in the track."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    entries = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.array("text", F.lit("end")))
    page = F.struct(F.col("turn").cast("int").alias("page"), F.concat(F.lit("P"), "turn").alias("label"), entries.alias("entries"))
    pages = F.map_from_entries(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("turn", page.alias("p")))), lambda x: F.struct(x["turn"].cast("string"), x["p"]))))
    segments = F.array(F.struct(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("P"), "turn").alias("label"), entries.alias("entries")))).alias("page_segments")))
    packed = rows.groupBy("conv_id").agg(F.to_json(F.struct(pages.alias("pages"))).alias("now"), F.to_json(F.struct(segments.alias("subtitles"))).alias("old"))
    payload = F.when(F.col("conv_id") % 2 == 0, F.col("now")).otherwise(F.col("old"))
    out = R.track(R.cached_pages(packed.select("conv_id", payload.alias("payload")), "conv_id", "payload"), "conv_id")
    return out.select("conv_id", "page", "label", F.size("entries").alias("entries"), F.col("place").cast("long").alias("place"), F.md5(F.element_at("entries", 1)).alias("first"))


def cache(spark: SparkSession, d: str) -> DataFrame:
    """Orders looked up among finished ones by all fields of the key."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("model"), "o_orderstatus", F.floor(F.col("o_totalprice") % 5).cast("long").alias("entries"))
    cached = o.where("o_orderstatus = 'F'").select("o_custkey", "model", "o_orderkey", "entries")
    return R.cache_hits(o.select("o_orderkey", "o_custkey", "model"), cached, ["o_custkey", "model"], "entries", "o_orderkey").select("o_orderkey", "entries", "hit")


def manifests(spark: SparkSession, d: str) -> DataFrame:
    """Orders as manifests of parts, of which large ones are gone."""
    return R.whole(table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), table(spark, d, "part").where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey")), "l_orderkey", "l_partkey")


def migrated(spark: SparkSession, d: str) -> DataFrame:
    """Manifests of documents filled in from a registry of pages, ids compared without case."""
    name = lambda c: F.nullif(c, F.lit(""))
    m = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("BVa"), "doc_id")).alias("source_id"), F.left("text", F.lit(20)).alias("title"), F.col("source").alias("creator"))
    m = m.withColumn("id", F.coalesce(name(F.col("source_id")), F.concat(F.lit("bVA"), "doc_id")))
    r = table(spark, d, "pages").groupBy("page_id").agg(F.max("url").alias("url")).select(
        F.lower(F.concat(F.lit("BVA"), "page_id")).alias("key"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("T"), "page_id")).otherwise("").alias("r_title"), F.when(F.col("page_id") % 5 == 0, F.lit("up")).alias("r_author"), "url")
    both = m.join(r, F.lower("id") == F.col("key"), "left")
    return both.select("doc_id", F.concat(F.lit("migration-"), "id").alias("queue_id"), F.coalesce(name(F.col("r_title")), name(F.col("title")), "id").alias("title"), F.coalesce("r_author", "creator").alias("author"), F.coalesce("url", F.lit("")).alias("url"))


def outlines(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as lessons, kind and day as chapters."""
    e = table(spark, d, "events").select("user_id", "event_id", F.concat_ws(" ", "event_type", F.floor(N.seconds(F.col("ts")) / 86400).cast("string")).alias("title"))
    return R.outline(e, "user_id", "event_id", "title", "event_id")


def metrics(spark: SparkSession, d: str) -> DataFrame:
    """Stages of each order (its lines by number) with the first stage measured again; totals and credits."""
    stages = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("stage"), F.floor("l_extendedprice").cast("long").alias("ms"), F.col("l_quantity").cast("long").alias("i"), F.col("l_partkey").alias("o"))
    again = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("stage"), F.floor("o_totalprice").cast("long").alias("ms"), F.col("o_custkey").alias("i"), F.lit(0).cast("long").alias("o"))
    merged = stages.where("stage <> 1").unionByName(again)
    out = merged.groupBy("l_orderkey").agg(F.sum("ms").alias("ms"), F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"))
    return out.select("l_orderkey", F.round(F.col("ms") / 1000, 3).alias("elapsed_seconds"), "input_tokens", "output_tokens", N.credits(F.col("input_tokens"), F.col("output_tokens"), F.lit(0)).alias("credits"))


def learning_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Per user: stages completed (distinct), sessions, and the six latest events."""
    e = table(spark, d, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))))
    stage = F.when(F.col("event_type") == "purchase", F.get_json_object("props", "$.k"))
    recent = F.array_sort(F.collect_list(F.when(F.col("n") <= 6, F.struct("n", F.col("event_id").cast("string").alias("id")))))
    out = e.groupBy("user_id").agg(F.count_distinct(stage).alias("stages"), F.count_distinct(F.floor(N.seconds(F.col("ts")) / 86400)).alias("sessions"), recent.alias("r"))
    return out.select("user_id", "stages", "sessions", F.array_join(F.transform("r", lambda x: x["id"]), ",").alias("recent"))


def overlays(spark: SparkSession, d: str) -> DataFrame:
    """Orders as records laid over older ones; a stated null path stays null, a null title does not."""
    k = F.col("o_orderkey")
    new = F.when(k % 4 == 1, '{"path": null, "title": null}').when(k % 4 == 2, F.concat(F.lit('{"path": "n'), k, F.lit('", "title": "N"}'))).when(k % 4 == 3, "{}")
    old = F.when(k % 3 != 0, F.concat(F.lit('{"path": "o'), "o_custkey", F.lit('"}')))
    return table(spark, d, "orders").select("o_orderkey", R.overlaid(new, old, "path").alias("path"), R.overlaid(new, old, "title", F.lit("untitled")).alias("title"))


def deletions(spark: SparkSession, d: str) -> DataFrame:
    """Packages of toxic documents deleted from pages (by path or source id) and conversations (by the package their path lies in)."""
    gone = table(spark, d, "labels").where("toxic = 1").select(F.concat(F.lit("m/"), "doc_id").alias("path"), (F.col("doc_id") * 2).cast("string").alias("source"))
    pages = table(spark, d, "pages").select(F.lit("pages").alias("kind"), F.col("page_id").alias("id"), F.concat(F.lit("m/"), "page_id").alias("path"))
    turns = table(spark, d, "conversations").select(F.lit("turns").alias("kind"), F.col("conv_id").alias("id"), F.concat_ws("/", F.lit("m"), "conv_id", "turn").alias("path"))
    rows = R.without_packages(pages.unionByName(turns), gone, F.substring_index("path", "/", 2), F.col("id").cast("string"))
    return rows.groupBy("kind", "removed").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def unlabelled(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a label: filled in from the pages, or still missing."""
    missing = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")
    cached = table(spark, d, "pages").select(F.col("page_id").alias("doc_id")).distinct().withColumn("there", F.lit(True))
    return missing.join(cached, "doc_id", "left").select("doc_id", F.coalesce("there", F.lit(False)).alias("from_cache"))


def folders(spark: SparkSession, d: str) -> DataFrame:
    """Nations as pinned sources in tracked order, untracked last, if they have customers; customers of others are miscellaneous."""
    pinned = table(spark, d, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("key"))
    tracked = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(F.min("s_suppkey").alias("priority"))
    customers = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.count("*").alias("n"))
    # nations are a fixed list, so one window over them is small
    place = F.row_number().over(Window.orderBy(F.col("priority").asc_nulls_last(), "key"))
    own = pinned.join(tracked, "key", "left").withColumn("place", place).join(customers, "key").select(F.col("key").cast("string").alias("folder"), "place", "n")
    rest = customers.join(pinned, "key", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("misc").alias("folder"), F.lit(None).cast("int").alias("place"), "n")
    return own.unionByName(rest)


def results(spark: SparkSession, d: str) -> DataFrame:
    """Lines as results that come back for parts, those of large parts unasked for."""
    lines = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber").where("l_linenumber > 2")
    asked = table(spark, d, "part").where("p_size < 45").select(F.col("p_partkey").alias("l_partkey"))
    return R.collected(asked, lines, "l_partkey", ["l_orderkey", "l_linenumber"])


def skipped(spark: SparkSession, d: str) -> DataFrame:
    """What a migration does with documents, by reason, and creators expected but not seen."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id").distinct().withColumn("labelled", F.lit(True)), "doc_id", "left")
    n = F.coalesce(F.length("text"), F.lit(0))
    reason = F.when(n == 0, "empty").when(F.col("labelled").isNull(), "unlabelled").when(n < 400, "short").otherwise("migrated")
    counts = docs.groupBy(reason.alias("id")).agg(F.count("*").alias("n"), F.sum(n).cast("long").alias("chars"))
    expected = spark.createDataFrame([(x,) for x in ("src0", "src1", "nobody")], "source string").join(docs.select("source").distinct(), "source", "left_anti")
    return counts.unionByName(expected.select(F.concat(F.lit("missing "), "source").alias("id"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("chars")))


def pauses(spark: SparkSession, d: str) -> DataFrame:
    """Each user's latest pause (an error pauses for some hours) as of a given day: one that ended is lifted."""
    hours = F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0)) % 48 + 1
    paused = table(spark, d, "events").where("event_type = 'error'").select("user_id", "event_id", (N.micros(F.col("ts")) + hours * 3_600_000_000).alias("until"))
    last = paused.groupBy("user_id").agg(F.max_by("until", "event_id").alias("until"))
    open_ = F.col("until") > PAUSE_NOW
    return last.select("user_id", open_.alias("paused"), F.when(open_, F.col("until")).alias("until"))


#: The moment pauses are judged at, in microseconds since 1970 (2024-01-20).
PAUSE_NOW = 1_705_708_800_000_000
THOUGHTLESS = stripped(f"regexp_replace({replaced(r'(?is)<think\b[^>]*>.*?</think>')}, '(?i)</?think\\b[^>]*>', '', 'g')")
ARTIFACT = f"""array_to_string(list_filter([CASE WHEN regexp_matches(left({THOUGHTLESS}, 900), {quoted(C.SELF_TALK)}) THEN 'self_talk' END,
    CASE WHEN length({THOUGHTLESS}) < CASE WHEN length(text) % 2 = 0 THEN least(1200, greatest(600, floor(length(text) * 0.16))) ELSE 500 END THEN 'short' END,
    CASE WHEN NOT regexp_matches({THOUGHTLESS}, {quoted(C.HEADING)}) THEN 'no_heading' END, CASE WHEN NOT regexp_matches({THOUGHTLESS}, {quoted(C.CLEAN_END)}) THEN 'cut' END], lambda x: x IS NOT NULL), ',')"""

QUERIES = {
    "q_summary_route": Query(eligibility, f"""WITH t AS (SELECT doc_id, {picked_sql(MODES, 'doc_id')} AS mode, n_chars, source FROM documents),
        r AS (SELECT doc_id, mode, concat_ws(',', CASE WHEN source = 'src0' THEN 'missing_key' END, CASE WHEN n_chars / 5 > 1800 THEN 'duration_over_route' END, CASE WHEN n_chars > 30000 THEN 'content_over_route' END, CASE WHEN mode IN ('off', 'skip') THEN 'disabled' END) AS reasons FROM t)
        SELECT doc_id, mode NOT IN ('off', 'skip') AND (mode IN ('force', 'always') OR reasons = '') AS eligible, reasons FROM r"""),
    "q_source_types": Query(source_types, f"""SELECT lang, CASE {picked_sql(LABELS, 'doc_id')} WHEN 'SenseVoice ' THEN 'local_transcript' WHEN '本地 ' THEN 'local_transcript' WHEN '音频转写 ' THEN 'audio_transcript' WHEN 'CC 字幕 ' THEN 'bilibili_subtitle' ELSE 'merged_text' END AS kind,
        count(*) AS n FROM documents GROUP BY 1, 2"""),
    "q_artifact_check": Query(each(lambda t: F.array_join(C.artifact_issues(t, F.length(t) % 2 == 0, F.length(t)), ",")), of_more(ARTIFACT)),
    "q_cleaning_accepted": Query(cleaning_accepted, """WITH t AS (SELECT l_orderkey, l_quantity::INT AS m, l_partkey % 90 AS k, l_linenumber - 1 AS lost, floor(l_extendedprice / 10) AS s, floor(l_extendedprice * (1 - l_discount * 4) / 10) AS c FROM lineitem)
        SELECT l_orderkey, count(*) FILTER (lost <= CASE WHEN m < 5 THEN 0 ELSE greatest(1, floor(m * 0.05::DOUBLE)) END AND lost <= CASE WHEN k < 8 THEN 0 ELSE greatest(1, floor(k * 0.05::DOUBLE)) END) AS accepted,
               count(*) FILTER (c < greatest(240, floor(s * 0.75::DOUBLE)) AND s > 800) AS short, count(*) AS n FROM t GROUP BY 1"""),
    "q_cleaning_lengths": Query(cleaning_lengths, f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, doc_id % 8 AS k, {CJK_N}::DOUBLE / length(text) AS share FROM documents),
        c AS (SELECT doc_id, n, share, k, (CASE WHEN k = 7 THEN n * 2 WHEN k = 6 THEN floor(n * 0.3::DOUBLE) ELSE floor(n * (k + 3) / 8) END) AS m FROM t)
        SELECT doc_id, concat_ws(',', CASE WHEN n > 800 AND m / n < CASE WHEN share < 0.12 AND k = 6 THEN 0.24 ELSE 0.72 END THEN 'short' END, CASE WHEN n > 800 AND m / n > 1.45 THEN 'long' END) AS issues FROM c"""),
    "q_published": Query(published, PUBLISHED),
    "q_page_cache": Query(page_cache, """WITH t AS (SELECT DISTINCT conv_id, turn, text FROM conversations WHERE coalesce(text, '') <> '' AND (conv_id % 2 = 0 OR turn > 0))
        SELECT conv_id, turn::INT AS page, 'P' || turn AS label, 2 AS entries, (2 * (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1))::BIGINT AS place, md5(text) AS first FROM t"""),
    "q_cache_hits": Query(cache, """WITH c AS (SELECT o_custkey, o_orderpriority, arg_max(floor(o_totalprice % 5)::BIGINT, o_orderkey) AS entries FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2)
        SELECT o_orderkey, coalesce(entries, 0) AS entries, coalesce(entries, 0) > 0 AS hit FROM orders LEFT JOIN c USING (o_custkey, o_orderpriority)"""),
    "q_manifest_whole": Query(manifests, "SELECT l_orderkey, count(*) AS files, bool_and(l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 40)) AS valid FROM lineitem GROUP BY 1"),
    "q_migrated_rows": Query(migrated, """WITH m AS (SELECT doc_id, left(text, 20) AS title, source, CASE WHEN doc_id % 4 = 0 THEN 'bVA' || doc_id ELSE 'BVa' || doc_id END AS id FROM documents),
        r AS (SELECT page_id, max(url) AS url FROM pages GROUP BY 1)
        SELECT doc_id, 'migration-' || id AS queue_id, coalesce(CASE WHEN page_id % 3 = 0 THEN 'T' || page_id END, nullif(m.title, ''), id) AS title, CASE WHEN page_id % 5 = 0 THEN 'up' ELSE source END AS author, coalesce(url, '') AS url
        FROM m LEFT JOIN r ON page_id = doc_id"""),
    "q_outline": Query(outlines, """WITH e AS (SELECT user_id, event_id, event_type || ' ' || (epoch_us(ts) // 86400000000) AS title FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, title ORDER BY event_id) AS k FROM e),
        c AS (SELECT user_id, title, min(event_id) AS f, count(*) AS n, string_agg(event_id::VARCHAR, '|' ORDER BY event_id) FILTER (k <= 8) AS lessons FROM r GROUP BY 1, 2),
        p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY f)::INT AS chapter FROM c) SELECT user_id, chapter, title, n, lessons FROM p WHERE chapter <= 12"""),
    "q_metrics": Query(metrics, """WITH s AS (SELECT l_orderkey, floor(l_extendedprice)::BIGINT AS ms, l_quantity::BIGINT AS i, l_partkey AS o FROM lineitem WHERE l_linenumber <> 1 UNION ALL SELECT o_orderkey, floor(o_totalprice)::BIGINT, o_custkey, 0 FROM orders),
        t AS (SELECT l_orderkey, sum(ms)::BIGINT AS ms, sum(i)::BIGINT AS i, sum(o)::BIGINT AS o FROM s GROUP BY 1) SELECT l_orderkey, round(ms / 1000, 3) AS elapsed_seconds, i AS input_tokens, o AS output_tokens, i * 100 + o * 200 AS credits FROM t"""),
    "q_learning_summary": Query(learning_summaries, """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
        SELECT user_id, count(DISTINCT json_extract_string(props, '$.k')) FILTER (event_type = 'purchase') AS stages, count(DISTINCT epoch_us(ts) // 86400000000) AS sessions, string_agg(event_id::VARCHAR, ',' ORDER BY n) FILTER (n <= 6) AS recent FROM e GROUP BY 1"""),
    "q_record_overlay": Query(overlays, """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN NULL WHEN o_orderkey % 4 = 2 THEN 'n' || o_orderkey WHEN o_orderkey % 3 <> 0 THEN 'o' || o_custkey END AS path, CASE WHEN o_orderkey % 4 = 2 THEN 'N' ELSE 'untitled' END AS title FROM orders"""),
    "q_package_delete": Query(deletions, """WITH g AS (SELECT doc_id FROM labels WHERE toxic = 1), r AS (SELECT 'pages' AS kind, page_id AS id FROM pages UNION ALL SELECT 'turns', conv_id FROM conversations)
        SELECT kind, id IN (SELECT doc_id FROM g) OR id IN (SELECT doc_id * 2 FROM g) AS removed, count(*) AS n, min(id) AS first_id FROM r GROUP BY 1, 2"""),
    "q_unlabelled": Query(unlabelled, "SELECT doc_id, doc_id IN (SELECT page_id FROM pages) AS from_cache FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "q_folders": Query(folders, """WITH p AS (SELECT n_nationkey AS key, row_number() OVER (ORDER BY priority ASC NULLS LAST, n_nationkey)::INT AS place FROM nation LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS priority FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey WHERE n_regionkey <> 2)
        SELECT key::VARCHAR AS folder, place, count(*) AS n FROM p JOIN customer ON c_nationkey = key GROUP BY 1, 2 UNION ALL SELECT 'misc', NULL, count(*) FROM customer WHERE c_nationkey NOT IN (SELECT key FROM p)"""),
    "q_results": Query(results, """WITH f AS (SELECT l_partkey, min((l_orderkey, l_linenumber)) AS r FROM lineitem WHERE l_linenumber > 2 GROUP BY 1), a AS (SELECT DISTINCT p_partkey FROM part WHERE p_size < 45)
        SELECT coalesce(p_partkey, f.l_partkey) AS l_partkey, CASE WHEN p_partkey IS NULL THEN 'unknown' WHEN r IS NULL THEN 'missing' ELSE 'done' END AS state, r[1] AS l_orderkey, r[2] AS l_linenumber FROM a FULL JOIN f ON p_partkey = f.l_partkey"""),
    "q_migration_counts": Query(skipped, """WITH t AS (SELECT coalesce(length(text), 0) AS n, doc_id IN (SELECT doc_id FROM labels) AS l FROM documents)
        SELECT CASE WHEN n = 0 THEN 'empty' WHEN NOT l THEN 'unlabelled' WHEN n < 400 THEN 'short' ELSE 'migrated' END AS id, count(*) AS n, sum(n)::BIGINT AS chars FROM t GROUP BY 1
        UNION ALL SELECT 'missing ' || s, 0, 0 FROM (VALUES ('src0'), ('src1'), ('nobody')) AS v(s) WHERE s NOT IN (SELECT source FROM documents WHERE source IS NOT NULL)"""),
    "q_pauses": Query(pauses, f"""WITH p AS (SELECT user_id, event_id, epoch_us(ts) + (coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) % 48 + 1) * 3600000000 AS until FROM events WHERE event_type = 'error'),
        l AS (SELECT user_id, arg_max(until, event_id) AS until FROM p GROUP BY 1) SELECT user_id, until > {PAUSE_NOW} AS paused, CASE WHEN until > {PAUSE_NOW} THEN until END AS until FROM l"""),
}
