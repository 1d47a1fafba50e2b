"""Queries over packages of units (chunks, blocks, runs), JSON lines and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking
from ..sources import json_files
from ..sources.places import new_path
from ..streaming import tables
from .query import Query, table, values

TARGET, MOST, OVERLAP = 60, 75, 2
BLOCK_TARGET, BLOCK_MOST, BLOCK_LEAST = 20_000, 30_000, 10_000


def chunk_plan(spark: SparkSession, d: str) -> DataFrame:
    label, tokens = F.floor(F.col("turn") / 6).cast("string"), F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4)
    units = table(spark, d, "conversations").select("conv_id", "turn", label.alias("label"), tokens.alias("tokens"))
    return chunking.chunk_ranges(units, ["conv_id"], "turn", "label", "tokens", TARGET, MOST, OVERLAP)


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Packages of forty documents that follow each other."""
    size = F.length(F.coalesce("text", F.lit("")))
    docs = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 40).alias("package"), "doc_id", size.alias("chars"))
    return chunking.block_ranges(docs, ["package"], "doc_id", "chars", BLOCK_TARGET, BLOCK_MOST, BLOCK_LEAST)


def merges(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    role = F.when(F.col("event_type").isin("view", "click"), "browse").otherwise("act")
    parts = table(spark, d, "events").select("user_id", "event_id", role.alias("role"), F.array(k % 3).alias("terms"), (F.coalesce(k, F.lit(0)) % 7 == 0).alias("noisy"))
    return chunking.merge_ranges(parts, ["user_id"], "event_id", "role", "terms", "noisy")


def json_summary(spark: SparkSession, d: str) -> DataFrame:
    """Event properties as lines of one index per type; those of errors are cut short, so broken."""
    line = F.when(F.col("event_type") == "error", F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    return json_files.lines_summary(table(spark, d, "events").select("event_type", line.alias("line")), "line", ["k"], ["event_type"]).drop("ks")


#: Marked lines among others; a missing counter is 0, a missing flag false, a missing stage unknown.
LINES = [
    (1, '__APP_DISTILL_PROGRESS__={"message": "a", "percent": 10, "stage": "fetch"}'), (2, "plain output"), (3, "__APP_DISTILL_PROGRESS__={broken}"),
    (4, '__APP_DISTILL_PROGRESS__={"message": "b", "resumed": true, "chunkCompleted": 2, "chunkTotal": 5}'), (5, ""), (6, 'x __APP_DISTILL_PROGRESS__={"message": "c"}'),
]


def progress(spark: SparkSession, d: str) -> DataFrame:
    """The lines, and one for each event of a user's log."""
    logged = table(spark, d, "events").select(
        F.col("event_id").cast("int").alias("n"),
        F.concat(F.lit("__APP_DISTILL_PROGRESS__="), F.to_json(F.struct(F.col("event_type").alias("message"), F.when(F.col("event_type") != "error", F.col("event_id") % 100).alias("percent"), F.when(F.col("event_type") == "view", "chunk").alias("stage")))).alias("value"),
    )
    lines = spark.createDataFrame(LINES, "n int, value string").unionByName(logged)
    return json_files.progress_events(lines).select("message", "percent", "stage", "chunkCompleted", "chunkTotal", "resumed")


REGISTRY = [
    ('{"up_id": "u1", "last_sync": "t", "videos": {"BV1": {"title": "a", "status": "done"}, "BV2": {"title": "b"}}}',), ('{"up_id": "u2", "videos": []}',), ("broken",), (None,),
]


def registry(spark: SparkSession, d: str) -> DataFrame:
    """Registry documents, and one a customer that holds the customer's name as a video."""
    video = F.struct(F.col("c_name").alias("title"), F.when(F.col("c_acctbal") > 0, "done").alias("status"))
    own = F.to_json(F.struct(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("up_id"), F.map_from_arrays(F.array(F.lit("BV9")), F.array(video)).alias("videos")))
    rows = spark.createDataFrame(REGISTRY, "doc string").unionByName(table(spark, d, "customer").select(own.alias("doc")))
    return json_files.registry_rows(rows, "doc", "title string, status string").select("up_id", "key", "entry.title", "entry.status")


def stream_of(spark: SparkSession, d: str, name: str) -> DataFrame:
    return tables.arrived(spark, d, table(spark, d, name).schema, f"{name}.parquet")


def stream_known(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "known")
    tables.run(tables.first_seen(stream_of(spark, d, "events"), "user_id"), f"{path}-state", tables.to_versions(path))
    return spark.read.option("basePath", path).parquet(path).select("user_id")


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "windows")
    events = stream_of(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    tables.run(tables.windows(events, "at", "1 day", ["event_type"]), f"{path}-state", tables.to_versions(path), "update")
    out = tables.newest(spark, path, ["start", "event_type"])
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


QUERIES = {
    "q_chunk_plan": Query(chunk_plan, f"""
        WITH RECURSIVE u AS (SELECT conv_id, row_number() OVER w AS i, (turn // 6)::VARCHAR AS label, ceil(length(coalesce(text, '')) / 4)::BIGINT AS t FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        p AS (SELECT conv_id, list(label ORDER BY i) AS l, list(t ORDER BY i) AS t, count(*)::INT AS n FROM u GROUP BY conv_id),
        s AS (
          SELECT conv_id, 0 AS i, 1 AS lo, false AS fresh, []::INT[][] AS out FROM p
          UNION ALL
          SELECT conv_id, i, CASE WHEN large THEN greatest(lo, i + 1 - {OVERLAP}) ELSE lo END::INT, NOT large, CASE WHEN large THEN list_append(out, [lo, i]::INT[]) ELSE out END
          FROM (SELECT *, list_sum(l_t[lo:i]) > {MOST} AS large
                FROM (SELECT conv_id, i, l_t, CASE WHEN turned THEN i WHEN over THEN greatest(lo, i - {OVERLAP}) ELSE lo END::INT AS lo,
                             CASE WHEN turned OR over THEN list_append(out, [lo, i - 1]::INT[]) ELSE out END AS out
                      FROM (SELECT s.conv_id, s.i + 1 AS i, s.lo, s.out, p.t AS l_t, s.lo <= s.i AND p.l[s.i] <> p.l[s.i + 1] AS turned, s.lo <= s.i AND list_sum(p.t[s.lo:s.i + 1]) > {TARGET} AS over
                            FROM s JOIN p ON p.conv_id = s.conv_id AND s.i < p.n))))
        SELECT conv_id, k::INT AS chunk, r[1] AS first, r[2] AS last
        FROM (SELECT conv_id, unnest(out) AS r, generate_subscripts(out, 1) AS k
              FROM (SELECT s.conv_id, CASE WHEN fresh AND lo <= p.n THEN list_append(out, [lo, p.n]::INT[]) ELSE out END AS out FROM s JOIN p ON s.conv_id = p.conv_id AND s.i = p.n))"""),
    "q_block_tail_merge": Query(blocks, f"""
        WITH RECURSIVE c AS (SELECT doc_id // 40 AS package, row_number() OVER (PARTITION BY doc_id // 40 ORDER BY doc_id)::INT AS i, length(coalesce(text, ''))::BIGINT AS n FROM documents),
        s AS (SELECT package, i, n, 1 AS block, n AS held FROM c WHERE i = 1
              UNION ALL
              SELECT package, i, n, block + shut::INT, CASE WHEN shut THEN n ELSE held + n END
              FROM (SELECT c.package, c.i, c.n, s.block, s.held, s.held + c.n > {BLOCK_MOST} OR s.held >= {BLOCK_TARGET} AS shut FROM s JOIN c ON c.package = s.package AND c.i = s.i + 1)),
        b AS (SELECT package, block, min(i) AS first, max(i) AS last, sum(n) + 2 * (count(*) - 1) AS chars, max(block) OVER (PARTITION BY package) AS blocks FROM s GROUP BY package, block),
        m AS (SELECT package, CASE WHEN block = blocks AND block > 1 AND chars < {BLOCK_LEAST} THEN block - 1 ELSE block END AS block, first, last FROM b)
        SELECT package, block::INT AS block, min(first)::INT AS first, max(last)::INT AS last FROM m GROUP BY package, block"""),
    "q_merge_groups": Query(merges, """
        WITH RECURSIVE e AS (SELECT user_id, row_number() OVER w AS i, CASE WHEN event_type IN ('view', 'click') THEN 'browse' ELSE 'act' END AS role, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
                             FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
        f AS (SELECT user_id, i::INT AS i, coalesce(k, 0) % 7 = 0 AS noisy, coalesce(role = lag(role) OVER w, false) AS same, coalesce(k % 3 = lag(k % 3) OVER w, false) AS shared FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i)),
        s AS (SELECT user_id, i, CASE WHEN noisy THEN 0 ELSE 1 END AS size, CASE WHEN noisy THEN 0 ELSE 1 END AS run FROM f WHERE i = 1
              UNION ALL
              SELECT f.user_id, f.i, CASE WHEN f.noisy THEN 0 WHEN s.size BETWEEN 1 AND 3 AND f.same AND (f.shared OR s.size < 3) THEN s.size + 1 ELSE 1 END,
                     CASE WHEN f.noisy THEN s.run WHEN s.size BETWEEN 1 AND 3 AND f.same AND (f.shared OR s.size < 3) THEN s.run ELSE s.run + 1 END
              FROM s JOIN f ON f.user_id = s.user_id AND f.i = s.i + 1),
        g AS (SELECT user_id, run, min(i) AS first, max(i) AS last FROM s WHERE size > 0 GROUP BY user_id, run HAVING count(*) > 1)
        SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY first)::INT AS merge, first::INT AS first, last::INT AS last FROM g"""),
    "q_jsonl_summary": Query(json_summary, "SELECT event_type, count(*) AS lines, count(*) FILTER (event_type = 'error') AS broken FROM events GROUP BY event_type"),
    "q_progress_events": Query(progress, """
        SELECT * FROM (VALUES ('a', 10.0::DOUBLE, 'fetch', 0.0::DOUBLE, 0.0::DOUBLE, false), ('b', 0.0, 'unknown', 2.0, 5.0, true)) AS v(message, percent, stage, chunkCompleted, chunkTotal, resumed)
        UNION ALL SELECT event_type, CASE WHEN event_type <> 'error' THEN event_id % 100 ELSE 0 END::DOUBLE, CASE WHEN event_type = 'view' THEN 'chunk' ELSE 'unknown' END, 0.0, 0.0, false FROM events"""),
    "q_registry_rows": Query(registry, f"SELECT * FROM {values([('u1', 'BV1', 'a', 'done'), ('u1', 'BV2', 'b', None)], 'up_id, key, title, status')} UNION ALL SELECT 'c' || c_custkey, 'BV9', c_name, CASE WHEN c_acctbal > 0 THEN 'done' END FROM customer"),
    "q_stream_known": Query(stream_known, "SELECT DISTINCT user_id FROM events"),
    "q_stream_windows": Query(stream_windows, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
}
