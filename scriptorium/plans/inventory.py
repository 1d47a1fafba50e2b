"""Queries over the archive of materials, its library and its queue.

A document with its label and page is a material: ``quality`` says whether it was
cleaned, ``toxic`` whether its summary failed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as X
from .query import Query, quoted, table, values
from .texts import NOISE, ROLE, TEXTS, of_texts, per_text, texts

WHITE = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
STRIP = f"regexp_replace(coalesce(text, ''), '^{WHITE}|{WHITE}$', '', 'g')"

EXTRA = [
    (-20, "```json\n{\"a\": 1}\n```"), (-21, "  <think>long\nthought</think>\n# X <THINK a>"), (-22, "P3、P12: 标题"), (-23, "12.3"), (-24, "# H\n> [link](http://x) ![i](u) `c` ```\ncode\n``` a_b"),
    (-25, "sk-ABC 123 ~"), (-26, "标题含非法字符: <> / \\ | ? * 但应该保留主要文字..."), (-27, "Request was REJECTED " + "x" * 200), (-28, "bearer abc.def"), (-29, "smtp授权 x"), (-30, "　全角　"),
    (-31, "P1　标题"), (-32, "你好　世界 再 见"), (-33, "㐀㐁㐂㐃㐄㐅㐆㐇 abc"), (-34, "P３、 12 标题"), (-35, "\u2003P7\u00a0：x"),
]
MORE = f"(SELECT doc_id, text FROM {TEXTS} UNION ALL SELECT doc_id, text FROM {values(EXTRA, 'doc_id, text')})"


def each(column):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = texts(spark, d).unionByName(spark.createDataFrame(EXTRA, "doc_id long, text string"))
        return rows.select("doc_id", column(F.col("text")).alias("result"))

    return run


def of_more(expr: str) -> str:
    return f"SELECT doc_id, {expr} AS result FROM {MORE}"


def materials(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    pages = table(spark, d, "pages").groupBy(F.col("page_id").alias("doc_id")).agg(F.min("url").alias("url"))
    n = F.col("n_chars")
    cleaned, failed = F.coalesce(F.col("quality") == 1, F.lit(False)), F.coalesce(F.col("toxic") == 1, F.lit(False))
    summary = cleaned & ~failed & (n > 3000)
    return table(spark, d, "documents").join(labels, "doc_id", "left").join(pages, "doc_id", "left").select(
        "doc_id", F.col("source").alias("creator"), F.left("text", F.lit(30)).alias("title"), "url",
        (n > 100).alias("raw"), cleaned.alias("cleaned"), F.col("url").isNotNull().alias("email"), summary.alias("summary"),
        F.when(failed, "failed").when(cleaned & (n > 2000), "summary_ready").otherwise("").alias("status"),
        F.when(summary, F.floor(n / 10)).otherwise(0).alias("summary_chars"), F.when(cleaned, n - 10).otherwise(0).alias("clean_chars"), F.when(n > 100, n).otherwise(0).alias("raw_chars"),
        (F.col("doc_id") * 7919 % 100_000).alias("updated_at"),
    )


MATERIALS = """(SELECT doc_id, source AS creator, left(text, 30) AS title, url, n_chars > 100 AS raw, coalesce(quality = 1, false) AS cleaned, url IS NOT NULL AS email,
      coalesce(quality = 1, false) AND NOT coalesce(toxic = 1, false) AND n_chars > 3000 AS summary,
      CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 1 AND n_chars > 2000 THEN 'summary_ready' ELSE '' END AS status,
      CASE WHEN quality = 1 AND NOT coalesce(toxic = 1, false) AND n_chars > 3000 THEN n_chars // 10 ELSE 0 END AS summary_chars,
      CASE WHEN quality = 1 THEN n_chars - 10 ELSE 0 END AS clean_chars, CASE WHEN n_chars > 100 THEN n_chars ELSE 0 END AS raw_chars, doc_id * 7919 % 100000 AS updated_at
    FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id)
    LEFT JOIN (SELECT page_id AS doc_id, min(url) AS url FROM pages GROUP BY 1) p USING (doc_id))"""
ISSUE_SQL = "(status = 'failed' OR NOT (raw OR cleaned OR email OR summary) OR (status = 'summary_ready' AND NOT summary))"
LONG_SQL = "(NOT summary AND cleaned)"


def issue():
    """Failed, nothing there, or a summary that is said to be there and is not."""
    nothing = ~(F.col("raw") | F.col("cleaned") | F.col("email") | F.col("summary"))
    return (F.col("status") == "failed") | nothing | ((F.col("status") == "summary_ready") & ~F.col("summary"))


def long_draft():
    return ~F.col("summary") & F.col("cleaned")


def first_above_zero(*names: str):
    return F.coalesce(*(F.nullif(F.col(n), F.lit(0)) for n in names), F.lit(0)).cast("long")


def archive(spark: SparkSession, d: str) -> DataFrame:
    """The archive: stage, length and reading place of each material, and what it counts as."""
    stage = F.when(F.col("summary"), "summary_ready").when(F.col("status") == "failed", "summary_failed").when(F.col("cleaned"), "content_ready").when(F.col("raw"), "transcript_ready").otherwise("material_ready")
    path = F.when(F.col("cleaned"), "clean.md").when(F.col("email"), "email.md").when(F.col("summary"), "summary.md").when(F.col("raw"), "raw.txt").otherwise("")
    return materials(spark, d).select("doc_id", stage.alias("stage"), first_above_zero("summary_chars", "clean_chars", "raw_chars").alias("chars"), path.alias("path"), issue().alias("issue"), long_draft().alias("long"), (F.col("cleaned") | F.col("raw")).alias("ready"))


def pinned(spark: SparkSession, d: str) -> DataFrame:
    """Names of pinned creators, in odd spelling."""
    return spark.createDataFrame([(f"  SRC{i} ",) for i in (0, 3, 5)], "name string").select(X.normalize_name(F.col("name")).alias("key"))


PINNED = "('src0', 'src3', 'src5')"


def facets(spark: SparkSession, d: str) -> DataFrame:
    rows = materials(spark, d)
    own = rows.withColumn("key", X.normalize_name(F.col("creator"))).join(F.broadcast(pinned(spark, d)), "key", "left_semi").agg(F.count("*").alias("pinned"))  # three literal names
    counts = rows.agg(F.count("*").alias("all"), F.count_if(long_draft()).alias("long"), F.count_if(F.col("summary")).alias("short"), F.count_if(issue()).alias("issue")).join(own)  # a row each
    counts = counts.withColumn("misc", F.col("all") - F.col("pinned"))
    return counts.unpivot([], ["all", "pinned", "misc", "long", "short", "issue"], "id", "n")


def search(spark: SparkSession, d: str) -> DataFrame:
    """Materials of creators that are not pinned whose title, creator or address holds a word."""
    rows = materials(spark, d).where(F.col("raw") | F.col("cleaned") | F.col("summary") | (F.col("status") == "failed"))
    rows = rows.withColumn("key", X.normalize_name(F.col("creator"))).join(F.broadcast(pinned(spark, d)), "key", "left_anti")
    return rows.where(F.contains(F.lower(F.concat_ws(" ", "title", "creator", "url")), F.lit("the"))).select("doc_id", "creator")


def library(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("item"), F.when(F.col("o_orderpriority") < "3", F.concat(F.lit("BV"), F.col("o_custkey").cast("string"))).otherwise("").alias("bvid"), F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("source_id"), F.col("o_orderdate").alias("published"))


LIBRARY = "(SELECT o_orderkey AS item, CASE WHEN o_orderpriority < '3' THEN 'BV' || o_custkey ELSE '' END AS bvid, 's' || o_orderkey AS source_id, o_orderdate AS published FROM orders)"


def library_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Items exported one after the other: the last of a key replaces those before; newest first in a library's list."""
    key = F.coalesce(F.nullif("bvid", F.lit("")), F.col("source_id"))
    return library(spark, d).groupBy(key.alias("key")).agg(F.max(F.struct("item", "published")).alias("m")).select("key", "m.item", "m.published")


def library_remove(spark: SparkSession, d: str) -> DataFrame:
    """What is removed when creators' items go by video or by source id, and what stays."""
    gone_by_video = table(spark, d, "customer").where("c_acctbal < 0").select(F.concat(F.lit("BV"), F.col("c_custkey").cast("string")).alias("bvid"))
    gone_by_id = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.concat(F.lit("s"), F.col("l_orderkey").cast("string")).alias("source_id")).distinct()
    rows = library(spark, d).join(gone_by_video.withColumn("a", F.lit(True)), "bvid", "left").join(gone_by_id.withColumn("b", F.lit(True)), "source_id", "left")
    removed = F.coalesce("a", F.lit(False)) | F.coalesce("b", F.lit(False))
    return rows.groupBy(removed.alias("removed")).agg(F.count("*").alias("n"), F.min("item").alias("first_item"))


def queue_rows(spark: SparkSession, d: str) -> DataFrame:
    """Raw events as rows of the work queue: enums checked, modes filled in by what else the row says."""
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0))
    raw = table(spark, d, "events").select(
        "event_id", F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("BV"), k.cast("string"))).alias("bvid"), F.col("event_type").alias("origin"),
        F.element_at(F.array(*map(F.lit, ("AUTO ", "Force", "off", "x", ""))), (k % 5 + 1).cast("int")).alias("editorial"),
        F.element_at(F.array(*map(F.lit, ("subtitle_only", "FULL_EDITORIAL", "?"))), (k % 3 + 1).cast("int")).alias("pipeline"),
    )
    mode = F.lower(F.trim("editorial"))
    editorial = F.when(mode.isin("force", "off"), mode).otherwise("auto")
    given = F.lower(F.trim("pipeline"))
    pipeline = F.when(given.isin("subtitle_only", "full_editorial"), given).when(editorial == "off", "subtitle_only").otherwise("full_editorial")
    rank = F.when(F.col("origin") == "click", 0).when(F.col("origin").isin("view", "signup"), 1).when(F.col("origin") == "purchase", 2).when(F.col("origin") == "error", 3).otherwise(4)
    return raw.where("bvid <> ''").select("event_id", "bvid", editorial.alias("editorial"), pipeline.alias("pipeline"), rank.alias("rank"))


QUEUE_ROWS = """
    WITH e AS (SELECT event_id, event_type, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events),
    m AS (SELECT *, CASE k % 5 WHEN 1 THEN 'force' WHEN 2 THEN 'off' ELSE 'auto' END AS editorial FROM e WHERE k % 5 <> 0)
    SELECT event_id, 'BV' || k AS bvid, editorial, CASE k % 3 WHEN 0 THEN 'subtitle_only' WHEN 1 THEN 'full_editorial' ELSE CASE editorial WHEN 'off' THEN 'subtitle_only' ELSE 'full_editorial' END END AS pipeline,
           CASE WHEN event_type = 'click' THEN 0 WHEN event_type IN ('view', 'signup') THEN 1 WHEN event_type = 'purchase' THEN 2 WHEN event_type = 'error' THEN 3 ELSE 4 END AS rank FROM m"""


def queue_append(spark: SparkSession, d: str) -> DataFrame:
    """A queue of orders takes in customers' new items: pending rows, new ones once each, then finished ones."""
    o = table(spark, d, "orders")
    now = o.where("o_totalprice > 150000").groupBy(F.col("o_custkey").alias("bvid")).agg(F.max(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))).alias("m")).select("bvid", "m.id", "m.status")
    new = o.groupBy(F.col("o_custkey").alias("bvid")).agg(F.min("o_orderkey").alias("id")).join(now, "bvid", "left_anti")
    part = F.when(F.col("status") == "O", 0).otherwise(2)
    return now.select("bvid", "id", part.alias("part")).unionByName(new.select("bvid", "id", F.lit(1).alias("part")))


def recovered(spark: SparkSession, d: str) -> DataFrame:
    """Rows that were in work when the program ended wait again; a patch of one creator's rows; the rest unchanged."""
    o = table(spark, d, "orders")
    state = F.when(F.col("o_orderstatus") == "P", "queued").when(F.col("o_orderstatus") == "O", "waiting").otherwise("done")
    return o.groupBy(F.when(F.col("o_orderpriority").startswith("1"), "patched").otherwise(state).alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("changed"))


def pinned_sources(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each source counts; the 48 pinned last."""
    e = table(spark, d, "events").where("event_type = 'signup'")
    firsts = e.groupBy(F.col("user_id").alias("mid")).agg(F.min(F.struct("event_id", "ts")).alias("m")).select("mid", F.col("m.ts").alias("pinned_at"))
    return firsts.orderBy(F.desc("pinned_at"), "mid").limit(48)


def registry_list(spark: SparkSession, d: str) -> DataFrame:
    """The newest thousand of a registry by publication, last sight and id."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("up"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("published"), F.col("o_totalprice").alias("seen"))
    return o.orderBy(F.desc("published"), F.desc("seen"), F.desc("id")).limit(1000)


def numbers_shown(spark: SparkSession, d: str) -> DataFrame:
    price = F.floor(F.col("o_totalprice") * F.col("o_custkey"))
    size = price.cast("double") / F.when(F.col("o_orderkey") % 2 == 0, 4096.0).otherwise(1.0)
    seconds = F.floor(F.col("o_totalprice") / 7).cast("long")
    return table(spark, d, "orders").select(
        "o_orderkey", L.let(price.cast("long"), L.compact_number).alias("compact"), L.elapsed(seconds).alias("elapsed"), L.duration_text(seconds).alias("duration"),
        L.ago(seconds * 10_000).alias("ago"), L.bar_percent(F.col("o_totalprice"), F.lit(400_000.0)).alias("bar"), L.byte_size(size).alias("bytes"),
    )


NUMBERS = """
    WITH t AS (SELECT o_orderkey, o_totalprice AS p, floor(o_totalprice * o_custkey)::BIGINT AS v, floor(o_totalprice / 7)::BIGINT AS s FROM orders)
    SELECT o_orderkey,
      CASE WHEN v <= 0 THEN '0' WHEN v >= 100000000 THEN printf('%.2f 亿', v / 1e8 + CASE WHEN v / 1e8 * 8 = floor(v / 1e8 * 8) AND v / 1e8 * 8 % 2 = 1 THEN 0.001 ELSE 0 END) WHEN v >= 10000 THEN printf('%.1f 万', v / 1e4 + CASE WHEN v / 1e4 * 4 = floor(v / 1e4 * 4) AND v / 1e4 * 4 % 2 = 1 THEN 0.01 ELSE 0 END) ELSE v::VARCHAR END AS compact,
      CASE WHEN s <= 0 THEN '' WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' || CASE WHEN s % 60 > 0 THEN ' ' || (s % 60) || 's' ELSE '' END
           ELSE (s // 3600) || 'h' || CASE WHEN s // 60 % 60 > 0 THEN ' ' || (s // 60 % 60) || 'm' ELSE '' END END AS elapsed,
      CASE WHEN s <= 0 THEN '' WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS duration,
      CASE WHEN s * 10 < 60 THEN '刚刚继续过' WHEN s * 10 < 3600 THEN greatest(1, floor(s * 10 / 60 + 0.5)::INT) || ' 分钟前' WHEN s * 10 < 86400 THEN greatest(1, floor(s * 10 / 3600 + 0.5)::INT) || ' 小时前'
           WHEN s * 10 < 604800 THEN greatest(1, floor(s * 10 / 86400 + 0.5)::INT) || ' 天前' ELSE '' END AS ago,
      CASE WHEN p > 0 THEN greatest(8, least(100, floor(p / 400000.0::DOUBLE * 100 + 0.5)::INT)) ELSE 0 END AS bar,
      CASE WHEN b <= 0 THEN '0 B' ELSE CASE WHEN z >= 10 THEN printf('%.0f', z + CASE WHEN z - floor(z) = 0.5 THEN 0.1 ELSE 0 END) WHEN k = 0 THEN printf('%.0f', z + CASE WHEN z - floor(z) = 0.5 THEN 0.1 ELSE 0 END)
           ELSE printf('%.1f', z + CASE WHEN z * 4 = floor(z * 4) AND z * 4 % 2 = 1 THEN 0.01 ELSE 0 END) END || ['~ B', '~ KB', '~ MB', '~ GB'][k + 1][2:] END AS bytes
    FROM (SELECT *, b / CASE k WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 1073741824 END AS z FROM (SELECT *, CASE WHEN b >= 1073741824 THEN 3 WHEN b >= 1048576 THEN 2 WHEN b >= 1024 THEN 1 ELSE 0 END AS k
          FROM (SELECT *, v::DOUBLE / CASE WHEN o_orderkey % 2 = 0 THEN 4096 ELSE 1 END AS b FROM t)))"""


def cleaning_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Characters in and out of each conversation, their ratio, and its turns that cleaning emptied."""
    clean = X.normalize_whitespace(F.col("text"))
    rows = table(spark, d, "conversations").select("conv_id", F.length(F.coalesce("text", F.lit(""))).alias("i"), F.length(clean).alias("o"))
    out = rows.groupBy("conv_id").agg(F.count("*").alias("chunks"), F.sum("i").cast("long").alias("input_chars"), F.sum("o").cast("long").alias("output_chars"), F.count_if((F.col("o") == 0) & (F.col("i") > 0)).alias("warnings"))
    return out.withColumn("ratio", F.when(F.col("input_chars") > 0, F.round(F.col("output_chars") / F.col("input_chars"), 4)).otherwise(0.0))


def track_segments(spark: SparkSession, d: str) -> DataFrame:
    """Nested tracks (a conversation: a segment a role, its entries) flattened to entries with text and regrouped by segment."""
    entry = F.struct(F.col("turn").alias("start"), (F.col("turn") + 1).alias("end"), F.col("text").alias("content"))
    segments = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    tracks = segments.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("role", "entries"))).alias("segments"))
    flat = tracks.select("conv_id", F.posexplode("segments").alias("page", "s")).select("conv_id", (F.col("page") + 1).alias("page"), "s.role", F.explode("s.entries").alias("e"))
    flat = flat.where(F.length(F.trim(F.coalesce("e.content", F.lit("")))) > 0)
    kind = F.when(F.col("role").startswith("u"), "subtitle").otherwise("audio")
    return flat.groupBy("conv_id", "page", "role", kind.alias("kind")).agg(F.count("*").alias("entries"), F.min("e.start").alias("start"), F.max("e.end").alias("end"))


def label_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Per label the blocks (of forty documents) that hold it: how many, first and last."""
    pairs = table(spark, d, "documents").select(F.concat_ws("-", "lang", "source").alias("label"), F.floor(F.col("doc_id") / 40).alias("block")).distinct()
    return pairs.groupBy("label").agg(F.count("*").alias("blocks"), F.min("block").alias("first_block"), F.max("block").alias("last_block"))


def repeats(spark: SparkSession, d: str) -> DataFrame:
    """Titles within a brand: the nth repeat takes a suffix, up to 4; each has its neighbour as dependency and successor."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.element_at(F.split("p_name", " "), 1).alias("title"))
    order = Window.partitionBy("p_brand").orderBy("p_partkey")
    n = F.row_number().over(Window.partitionBy("p_brand", "title").orderBy("p_partkey"))
    name = F.when(n == 1, F.col("title")).otherwise(F.concat_ws(" ", "title", F.least(n, F.lit(4)).cast("string")))
    return p.select("p_partkey", name.alias("name"), F.lag("p_partkey").over(order).alias("after"), F.lead("p_partkey").over(order).alias("next"))


def valid_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges order - part of which both ends are valid, each once, and how many parts an order keeps."""
    edges = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").dropDuplicates()
    orders, parts = table(spark, d, "orders").where("o_orderstatus <> 'F'"), table(spark, d, "part").where("p_size <= 25")
    kept = edges.join(orders, edges.l_orderkey == orders.o_orderkey, "left_semi").join(parts, edges.l_partkey == parts.p_partkey, "left_semi")
    return kept.groupBy("l_orderkey").agg(F.count("*").alias("parts"), F.min("l_partkey").alias("first_part"))


#: A recording within both is one part.
AUDIO_BYTES, AUDIO_SECONDS = 24 * 1024 * 1024, 1500


def audio_parts(spark: SparkSession, d: str) -> DataFrame:
    """Logical parts of recordings: one if size and length allow, else as many as they ask for, at least two, of a minute or more; what is within half a second of the end starts no part."""
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") * 400).alias("bytes"), (F.col("o_totalprice") / 50).alias("seconds"))
    single = (F.col("bytes") <= AUDIO_BYTES) & (F.col("seconds") <= AUDIO_SECONDS)
    asked = F.greatest(F.lit(2), F.ceil(F.col("bytes") / AUDIO_BYTES).cast("int"), F.ceil(F.col("seconds") / AUDIO_SECONDS).cast("int"))
    step = F.when(single, F.col("seconds")).otherwise(F.greatest(F.lit(60.0), F.col("seconds") / asked))
    count = F.when(single, 1).otherwise(F.ceil((F.col("seconds") - 0.5) / F.col("step"))).cast("int")
    parts = o.withColumn("step", step).select("o_orderkey", "step", "seconds", F.explode(F.sequence(F.lit(0), count - 1)).alias("part"))
    start = F.col("part") * F.col("step")
    return parts.select("o_orderkey", (F.col("part") + 1).alias("part"), F.round(start * 1000).cast("long").alias("start_ms"), F.round(F.least("step", F.col("seconds") - start) * 1000).cast("long").alias("length_ms"))


def teaching_map(spark: SparkSession, d: str) -> DataFrame:
    rows = X.profiled(texts(spark, d), "text").withColumn("score", X.scored(F.col("size"), F.col("role"), F.col("noise")))
    return rows.where("score >= 4 and noise <> 'high'").select("doc_id", "role", "score")


def noise_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = texts(spark, d).select("doc_id", X.noise_level(F.col("text")).alias("noise"), F.size(X.noise_reasons(F.col("text"))).alias("reasons"))
    return rows.where("noise in ('medium', 'high')")


def deliver_once(spark: SparkSession, d: str) -> DataFrame:
    """What is still to be sent: no text goes twice to a recipient, nor one that was sent before."""
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("recipient"), F.sha1(F.coalesce("text", F.lit(""))).alias("content"))
    sent = docs.join(table(spark, d, "labels").where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi").select("recipient", "content").distinct()
    return docs.join(sent, ["recipient", "content"], "left_anti").groupBy("recipient", "content").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "recipient")


def merged_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies fetched twice: those that are there win, new ones are added; per thread how many came from where."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("thread"), F.col("l_linenumber").alias("reply"), "l_returnflag")
    # dealt once, by thread, into as many parts as the session sets; the largest of texts is found by sorting, which keeps no table of all replies in a task
    dealt = li.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "thread")
    place = F.when(F.col("l_returnflag") != "A", "there").when(F.col("l_returnflag") != "N", "more")
    fetched = dealt.select("thread", "reply", place.alias("place")).where("place IS NOT NULL").groupBy("thread", "reply").agg(F.max("place").alias("place"))
    both = fetched.select("thread", (F.col("place") == "there").cast("int").alias("old"))
    return both.groupBy("thread").agg(F.sum("old").cast("long").alias("kept"), F.count_if(F.col("old") == 0).alias("added"))


def badges(spark: SparkSession, d: str) -> DataFrame:
    """Badges of users by their events, and which of them are new against an earlier day."""
    def earned(rows: DataFrame) -> DataFrame:
        n, kinds = F.count("*"), F.count_distinct("event_type")
        codes = F.array_compact(F.array(F.when(n >= 1, "first"), F.when(n >= 8, "steady"), F.when(kinds >= 4, "broad")))
        return rows.groupBy("user_id").agg(codes.alias("codes")).select("user_id", F.explode("codes").alias("code"))

    events = table(spark, d, "events")
    return earned(events).join(earned(events.where("ts < '2024-01-04'")), ["user_id", "code"], "left_anti")


def best_audio(spark: SparkSession, d: str) -> DataFrame:
    """Of each order the line of most quantity, the first of equals; orders without a discount come last."""
    best = F.max(F.struct("l_quantity", (-F.col("l_linenumber")).alias("at"))).alias("b")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(best).select("l_orderkey", F.col("b.l_quantity").alias("quantity"), (-F.col("b.at")).alias("line"))


def replaced(pattern: str, to: str = "") -> str:
    return f"regexp_replace(coalesce(text, ''), {quoted(pattern)}, {quoted(to)}, 'g')"


def stripped(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WHITE}|{WHITE}$', '', 'g')"


SPACE = WHITE[1:-2]
TOKENS = f"list_filter(string_split_regex(coalesce(text, ''), '[，。、“”‘’：；（）()\\[\\]【】、《》{SPACE}/]+'), lambda x: length(x) >= 2)"
FENCE = r"(?is)^```(?:json|markdown|md)?\s*(.*?)\s*```$"
HAN_N, CJK_N, LATIN_N = "len(regexp_extract_all(coalesce(text, ''), '[一-鿿]'))", "len(regexp_extract_all(coalesce(text, ''), '[\\x{3400}-\\x{9fff}]'))", "len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]'))"
MARKDOWN = replaced("(?s)```.*?```", " ")
for _p, _t in ((r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]+)\]\([^)]*\)", r"\1"), ("[#>*_`~|:-]", " "), (WHITE, " ")):
    MARKDOWN = f"regexp_replace({MARKDOWN}, {quoted(_p)}, {quoted(_t)}, 'g')"

QUERIES = {
    "q_material_tokens": Query(each(lambda t: F.concat_ws("|", F.size(L.tokens(t)).cast("string"), F.md5(F.array_join(L.tokens(t), "|")))), of_more(
        f"concat_ws('|', len({TOKENS}), md5(array_to_string({TOKENS}, '|')))")),
    "q_truncate": Query(each(lambda t: X.truncate(X.normalize_whitespace(t), 120)), of_more("CASE WHEN length({c}) > 120 THEN rtrim(left({c}, 119)) || '…' ELSE {c} END".format(c=X.CLEAN_SQL))),
    "q_page_number": Query(each(L.page_number), of_more("coalesce(TRY_CAST(nullif(regexp_extract(coalesce(text, ''), 'P(\\d+)', 1), '') AS INT), 0)")),
    "q_page_prefix": Query(each(lambda t: F.md5(L.without_page(t))), of_more(f"md5(coalesce(nullif(regexp_replace({STRIP}, '^(?:P?\\pN+[.\\-、：:{SPACE}]*)+', ''), ''), {STRIP}))")),
    "q_fence_body": Query(each(lambda t: F.md5(L.fence_body(t))), of_more(f"md5(CASE WHEN regexp_matches({STRIP}, {quoted(FENCE)}) THEN {stripped(f'regexp_extract({STRIP}, {quoted(FENCE)}, 1)')} ELSE {STRIP} END)")),
    "q_without_thoughts": Query(each(lambda t: F.md5(L.without_thoughts(t))), of_more("md5(" + stripped(f"regexp_replace({replaced(r'(?is)<think\b[^>]*>.*?</think>')}, '(?i)</?think\\b[^>]*>', '', 'g')") + ")")),
    "q_plain_markdown": Query(each(lambda t: F.md5(L.plain_markdown(t))), of_more(f"md5(trim({MARKDOWN}))")),
    "q_clip": Query(each(lambda t: F.md5(L.clipped(t, 1000, " [cut]"))), of_more(f"md5(CASE WHEN length({STRIP}) <= 1000 THEN {STRIP} ELSE left({STRIP}, 1000) || ' [cut]' END)")),
    "q_secret": Query(each(L.secret), of_more(f"CASE WHEN regexp_full_match({STRIP}, '[\\x20-\\x7e]+') THEN {STRIP} ELSE '' END")),
    "q_cjk": Query(each(lambda t: F.concat_ws("|", L.guessed_language(t), F.round(L.cjk_share(t) * 10000).cast("long").cast("string"))), of_more(
        f"concat_ws('|', CASE WHEN {HAN_N} >= greatest(8, {LATIN_N}) THEN 'zh' END, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE round({CJK_N}::DOUBLE / length(text) * 10000)::BIGINT END)")),
    "q_forbidden": Query(each(lambda t: L.text_of(t).rlike(L.FORBIDDEN)), of_more(f"regexp_matches(coalesce(text, ''), {quoted(L.FORBIDDEN)})")),
    "q_usable_summary": Query(each(L.usable_summary), of_more(f"length({STRIP}) >= 120 AND NOT regexp_matches({STRIP}, {quoted(L.REJECTED)})")),
    "q_path_segment": Query(each(lambda t: L.path_segment(t, "untitled")), of_more(
        "trim(left(coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[<>:\"/\\\\|?*\\x00-\\x1F]', ' ', 'g'), '" + WHITE + "', ' ', 'g'), '[. ]+$', '')), ''), 'untitled'), 120))")),
    "q_archive_table": Query(archive, f"""SELECT doc_id, CASE WHEN summary THEN 'summary_ready' WHEN status = 'failed' THEN 'summary_failed' WHEN cleaned THEN 'content_ready' WHEN raw THEN 'transcript_ready' ELSE 'material_ready' END AS stage,
        coalesce(nullif(summary_chars, 0), nullif(clean_chars, 0), nullif(raw_chars, 0), 0)::BIGINT AS chars, CASE WHEN cleaned THEN 'clean.md' WHEN email THEN 'email.md' WHEN summary THEN 'summary.md' WHEN raw THEN 'raw.txt' ELSE '' END AS path,
        {ISSUE_SQL} AS issue, {LONG_SQL} AS long, cleaned OR raw AS ready FROM {MATERIALS}"""),
    "q_archive_facets": Query(facets, f"""WITH m AS (SELECT *, lower(trim(creator)) IN {PINNED} AS pin FROM {MATERIALS})
        SELECT 'all' AS id, count(*) AS n FROM m UNION ALL SELECT 'pinned', count(*) FILTER (pin) FROM m UNION ALL SELECT 'misc', count(*) FILTER (NOT pin) FROM m
        UNION ALL SELECT 'long', count(*) FILTER ({LONG_SQL}) FROM m UNION ALL SELECT 'short', count(*) FILTER (summary) FROM m UNION ALL SELECT 'issue', count(*) FILTER ({ISSUE_SQL}) FROM m"""),
    "q_archive_search": Query(search, f"""SELECT doc_id, creator FROM {MATERIALS} WHERE (raw OR cleaned OR summary OR status = 'failed') AND lower(trim(creator)) NOT IN {PINNED} AND contains(lower(concat_ws(' ', title, creator, url)), 'the')"""),
    "q_library_upsert": Query(library_upsert, f"SELECT coalesce(nullif(bvid, ''), source_id) AS key, max(item) AS item, arg_max(published, item) AS published FROM {LIBRARY} GROUP BY 1"),
    "q_library_remove": Query(library_remove, f"""SELECT bvid IN (SELECT 'BV' || c_custkey FROM customer WHERE c_acctbal < 0) OR source_id IN (SELECT 's' || l_orderkey FROM lineitem WHERE l_quantity >= 49) AS removed,
        count(*) AS n, min(item) AS first_item FROM {LIBRARY} GROUP BY 1"""),
    "q_queue_rows": Query(queue_rows, QUEUE_ROWS),
    "q_queue_append": Query(queue_append, """WITH c AS (SELECT o_custkey AS bvid, max(o_orderkey) AS id, arg_max(o_orderstatus, o_orderkey) AS status FROM orders WHERE o_totalprice > 150000 GROUP BY 1)
        SELECT bvid, id, CASE status WHEN 'O' THEN 0 ELSE 2 END AS part FROM c UNION ALL SELECT o_custkey, min(o_orderkey), 1 FROM orders WHERE o_custkey NOT IN (SELECT bvid FROM c) GROUP BY 1"""),
    "q_queue_recover": Query(recovered, """SELECT CASE WHEN o_orderpriority LIKE '1%' THEN 'patched' WHEN o_orderstatus = 'P' THEN 'queued' WHEN o_orderstatus = 'O' THEN 'waiting' ELSE 'done' END AS status,
        count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS changed FROM orders GROUP BY 1"""),
    "q_pinned_sources": Query(pinned_sources, "SELECT user_id AS mid, arg_min(ts, event_id) AS pinned_at FROM events WHERE event_type = 'signup' GROUP BY 1 ORDER BY pinned_at DESC, mid LIMIT 48"),
    "q_registry_list": Query(registry_list, "SELECT o_custkey AS up, o_orderkey AS id, o_orderdate AS published, o_totalprice AS seen FROM orders ORDER BY published DESC, seen DESC, id DESC LIMIT 1000"),
    "q_numbers_shown": Query(numbers_shown, NUMBERS),
    "q_cleaning_rollup": Query(cleaning_rollup, f"""WITH r AS (SELECT conv_id, length(coalesce(text, '')) AS i, length({X.CLEAN_SQL}) AS o FROM conversations)
        SELECT conv_id, count(*) AS chunks, sum(i)::BIGINT AS input_chars, sum(o)::BIGINT AS output_chars, count(*) FILTER (o = 0 AND i > 0) AS warnings, CASE WHEN sum(i) > 0 THEN round(sum(o)::DOUBLE / sum(i), 4) ELSE 0.0 END AS ratio FROM r GROUP BY 1"""),
    "q_track_segments": Query(track_segments, """WITH s AS (SELECT conv_id, role, dense_rank() OVER (PARTITION BY conv_id ORDER BY role)::INT AS page, turn, text FROM conversations)
        SELECT conv_id, page, role, CASE WHEN role LIKE 'u%' THEN 'subtitle' ELSE 'audio' END AS kind, count(*) AS entries, min(turn) AS start, max(turn + 1) AS "end" FROM s WHERE length(trim(coalesce(text, ''))) > 0 GROUP BY ALL"""),
    "q_label_blocks": Query(label_blocks, "SELECT concat_ws('-', lang, source) AS label, count(DISTINCT doc_id // 40) AS blocks, min(doc_id // 40) AS first_block, max(doc_id // 40) AS last_block FROM documents GROUP BY 1"),
    "q_title_repeats": Query(repeats, """WITH p AS (SELECT p_partkey, p_brand, split_part(p_name, ' ', 1) AS title FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, title ORDER BY p_partkey) AS n FROM p)
        SELECT p_partkey, CASE WHEN n = 1 THEN title ELSE title || ' ' || least(n, 4) END AS name, lag(p_partkey) OVER w AS after, lead(p_partkey) OVER w AS next FROM r WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)"""),
    "q_valid_edges": Query(valid_edges, """SELECT l_orderkey, count(DISTINCT l_partkey) AS parts, min(l_partkey) AS first_part FROM lineitem
        WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 25) GROUP BY 1"""),
    "q_audio_parts": Query(audio_parts, """WITH o AS (SELECT o_orderkey, o_totalprice * 400 AS bytes, o_totalprice / 50 AS seconds, o_totalprice * 400 <= 25165824 AND o_totalprice / 50 <= 1500 AS alone FROM orders),
        s AS (SELECT *, CASE WHEN alone THEN seconds ELSE greatest(60, seconds / greatest(2, ceil(bytes / 25165824)::INT, ceil(seconds / 1500)::INT)) END AS step FROM o),
        p AS (SELECT *, unnest(range(CASE WHEN alone THEN 1 ELSE ceil((seconds - 0.5) / step)::BIGINT END)) AS k FROM s)
        SELECT o_orderkey, (k + 1)::INT AS part, round(k * step * 1000)::BIGINT AS start_ms, round(least(step, seconds - k * step) * 1000)::BIGINT AS length_ms FROM p"""),
    "q_teaching_map": Query(teaching_map, f"""WITH t AS (SELECT doc_id, {ROLE} AS role, greatest(1, least(5, 1 + least(3, length({X.CLEAN_SQL}) // 900) + (({ROLE}) IN ('operation_steps', 'tool_config', 'troubleshooting', 'case_analysis', 'exam_training'))::INT - CASE {NOISE} WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END))::INT AS score, {NOISE} AS noise FROM {TEXTS})
        SELECT doc_id, role, score FROM t WHERE score >= 4 AND noise <> 'high'"""),
    "q_noise_segments": Query(noise_segments, f"""SELECT doc_id, {NOISE} AS noise, least(5, len(list_filter([{', '.join(map(quoted, X.NOISE))}], lambda k: contains(lower(coalesce(text, '')), k))))::INT AS reasons FROM {TEXTS} WHERE {NOISE} <> 'low'"""),
    "q_deliver_once": Query(deliver_once, """WITH d AS (SELECT doc_id, lang AS recipient, sha1(coalesce(text, '')) AS content FROM documents), s AS (SELECT DISTINCT recipient, content FROM d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))
        SELECT min(doc_id) AS doc_id, recipient FROM d ANTI JOIN s USING (recipient, content) GROUP BY recipient, content"""),
    "q_merged_replies": Query(merged_replies, """WITH t AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'A'), n AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'N' EXCEPT SELECT * FROM t),
        b AS (SELECT l_orderkey AS thread, 1 AS old FROM t UNION ALL SELECT l_orderkey, 0 FROM n) SELECT thread, sum(old)::BIGINT AS kept, count(*) FILTER (old = 0) AS added FROM b GROUP BY 1"""),
    "q_badges": Query(badges, """WITH a AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS k FROM events GROUP BY 1), b AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS k FROM events WHERE ts < '2024-01-04' GROUP BY 1),
        x AS (SELECT user_id, 'first' AS code FROM a UNION ALL SELECT user_id, 'steady' FROM a WHERE n >= 8 UNION ALL SELECT user_id, 'broad' FROM a WHERE k >= 4),
        y AS (SELECT user_id, 'first' AS code FROM b UNION ALL SELECT user_id, 'steady' FROM b WHERE n >= 8 UNION ALL SELECT user_id, 'broad' FROM b WHERE k >= 4) SELECT user_id, code FROM x EXCEPT SELECT user_id, code FROM y"""),
    "q_best_line": Query(best_audio, "SELECT l_orderkey, max(l_quantity) AS quantity, arg_min(l_linenumber, (-l_quantity, l_linenumber)) AS line FROM lineitem GROUP BY 1"),
}
