"""Queries over the queue and the event log: claiming, retries, streaks, usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import packing, relational
from .query import Query, table, values

AS_OF_MS = 860_000_000_000
# What marks an error as a configuration fault, and as one that no retry mends.
CONFIGURATION = "SESSDATA|登录|配置|凭证|Cookie|cookie|unauthorized|forbidden|401|403|API Key|授权"
NO_RETRY = "充电|付费|权限|无权限|不可访问|无法访问|会员|大会员|试看|付费专属|charge|paid|paywall|upower|HTTP Error 412|HTTP 412|Precondition Failed|playurl 未返回可用音频轨"
ERRORS = [(1, "network down", 0), (2, "HTTP Error 412 x", 0), (3, "403 权限", 1), (4, "请先登录", 0), (5, "timeout", 1), (6, "timeout", 2), (7, "timeout", 3), (8, "paid content", 2)]


def queue(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a work queue: rank of the source, state, due time."""
    rank = F.left("o_orderpriority", F.lit(1)).cast("int") - 1
    state = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "failed").otherwise("done")
    due = F.when(rank == 3, N.seconds(F.col("o_orderdate")) * 1000)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("creator"), rank.alias("rank"), state.alias("status"), due.alias("due"), N.seconds(F.col("o_orderdate")).alias("queued_at"))


QUEUE = """(SELECT o_orderkey AS id, o_custkey AS creator, left(o_orderpriority, 1)::INT - 1 AS rank, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'failed' ELSE 'done' END AS status,
    CASE WHEN left(o_orderpriority, 1) = '4' THEN epoch(o_orderdate)::BIGINT * 1000 END AS due, epoch(o_orderdate)::BIGINT AS queued_at FROM orders)"""


def claim(spark: SparkSession, d: str) -> DataFrame:
    ready = queue(spark, d).where(f"status = 'queued' and (due is null or due <= {AS_OF_MS})")
    return ready.orderBy("rank", "queued_at", "id").limit(1)


def status(spark: SparkSession, d: str) -> DataFrame:
    waiting = F.col("status") == "queued"
    return queue(spark, d).agg(
        F.count_if(waiting).alias("queued"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(waiting & (F.col("due").isNull() | (F.col("due") <= AS_OF_MS))).alias("claimable"), F.min(F.when(waiting & (F.col("due") > AS_OF_MS), F.col("due"))).alias("next_retry"),
    )


def retries(spark: SparkSession, d: str) -> DataFrame:
    """Outcome of a failed run: configuration faults pause, faults without a cure are skipped, others retry three times."""
    what = F.when(F.col("event_type") == "error", "HTTP Error 412").when(F.col("event_type") == "purchase", "PAID content").when(F.col("event_type") == "signup", "请先登录").otherwise("timeout")
    logged = table(spark, d, "events").select(F.col("event_id").alias("id"), what.alias("message"), (F.col("event_id") % 5).cast("int").alias("tries"))
    rows = logged.unionByName(spark.createDataFrame([(-i, m, n) for i, m, n in ERRORS], "id long, message string, tries int"))
    config, hopeless = F.col("message").rlike(f"(?i){CONFIGURATION}"), F.col("message").rlike(f"(?i){NO_RETRY}")
    state = F.when(config, "failed").when(hopeless, "skipped").when(F.col("tries") < 3, "queued").otherwise("failed")
    wait = F.when(state == "queued", N.retry_delay_ms(F.col("tries"))).otherwise(0)
    return rows.select("id", state.alias("status"), config.alias("pause"), wait.cast("long").alias("wait_ms"))


def backfill(spark: SparkSession, d: str) -> DataFrame:
    """Per creator, by priority, the newest item that is not known yet."""
    fresh = relational.unknown_rows(queue(spark, d), "id", queue(spark, d).where("status = 'done'").select("id"))
    return relational.top_per_group(fresh, ["creator"], [F.desc("queued_at"), F.desc("id")], 1).select("creator", "id", "queued_at")


def recent(spark: SparkSession, d: str) -> DataFrame:
    return queue(spark, d).orderBy(F.desc("queued_at"), F.desc("id")).limit(9).select("id", "creator", "queued_at")


def streaks(spark: SparkSession, d: str) -> DataFrame:
    return relational.streak(table(spark, d, "events").select("user_id", "ts"), "user_id", "ts", F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"), gap_seconds=86_400 * 3, stale_seconds=86_400 * 7)


def momentum(spark: SparkSession, d: str) -> DataFrame:
    as_of = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    e = table(spark, d, "events").where(F.col("ts") <= as_of)
    day = F.col("ts") >= F.date_trunc("DAY", as_of).cast("timestamp_ntz")
    return e.groupBy("event_type").agg(F.count_if(day).alias("today"), F.count_if(F.col("ts") >= as_of - F.expr("INTERVAL 24 HOURS")).alias("last_day"), F.max("ts").alias("latest"), F.count("*").alias("total"))


def usage(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    e = table(spark, d, "events").withColumn("k", k)
    return e.groupBy("event_type").agg(F.sum("k").alias("tokens"), F.count("k").alias("known"), F.round(F.avg("k"), 6).alias("mean"), N.credits(F.lit(0), F.lit(0), F.sum("k")).alias("credits"))


DEDUP = [(1, "q1", "b1"), (2, "q2", "b1"), (3, "q2", "b2"), (4, "q3", "b3"), (5, "q3", "b4"), (6, "q4", "b2"), (7, "q5", "b4")]


def two_keys(spark: SparkSession, d: str) -> DataFrame:
    """Queues of customers: of a customer's orders those stay whose state and priority no order that stayed has taken; and a literal queue."""
    own = table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("place"), F.col("o_orderstatus").alias("queue_id"), F.col("o_orderpriority").alias("bvid"))
    rows = own.unionByName(spark.createDataFrame([(-1, *r) for r in DEDUP], "owner long, place long, queue_id string, bvid string"))
    return packing.two_key_dedup(rows, "owner", "place", "queue_id", "bvid", 200)


def gaps(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user: events less than six hours apart."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    far = N.micros(F.col("ts")) - F.lag(N.micros(F.col("ts"))).over(w) > 6 * 3_600_000_000
    e = table(spark, d, "events").withColumn("new", F.coalesce(far, F.lit(True)).cast("int"))
    e = e.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("ts").alias("start"), F.max("ts").alias("end"))


QUERIES = {
    "q_queue_claim": Query(claim, f"SELECT * FROM {QUEUE} WHERE status = 'queued' AND (due IS NULL OR due <= {AS_OF_MS}) ORDER BY rank, queued_at, id LIMIT 1"),
    "q_queue_status": Query(status, f"""
        SELECT count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed,
               count(*) FILTER (status = 'queued' AND (due IS NULL OR due <= {AS_OF_MS})) AS claimable, min(due) FILTER (status = 'queued' AND due > {AS_OF_MS}) AS next_retry FROM {QUEUE}"""),
    "q_retry_transition": Query(retries, f"""
        SELECT id, CASE WHEN c THEN 'failed' WHEN h THEN 'skipped' WHEN tries < 3 THEN 'queued' ELSE 'failed' END AS status, c AS pause,
               CASE WHEN NOT c AND NOT h AND tries < 3 THEN CASE tries WHEN 0 THEN 300000 WHEN 1 THEN 1800000 ELSE 7200000 END ELSE 0 END::BIGINT AS wait_ms
        FROM (SELECT *, regexp_matches(message, '(?i){CONFIGURATION}') AS c, regexp_matches(message, '(?i){NO_RETRY}') AS h 
              FROM (SELECT -id AS id, message, tries FROM {values(ERRORS, 'id, message, tries')}
                    UNION ALL SELECT event_id, CASE event_type WHEN 'error' THEN 'HTTP Error 412' WHEN 'purchase' THEN 'PAID content' WHEN 'signup' THEN '请先登录' ELSE 'timeout' END, event_id % 5 FROM events))"""),
    "q_history_backfill": Query(backfill, f"""
        SELECT creator, id, queued_at FROM {QUEUE} WHERE status <> 'done' QUALIFY row_number() OVER (PARTITION BY creator ORDER BY queued_at DESC, id DESC) = 1"""),
    "q_recent_top_n": Query(recent, f"SELECT id, creator, queued_at FROM {QUEUE} ORDER BY queued_at DESC, id DESC LIMIT 9"),
    "q_streak": Query(streaks, """
        WITH g AS (SELECT user_id, ts, coalesce(epoch_us(lag(ts) OVER w) - epoch_us(ts), 0) / 1e6 > 259200 AS broken FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC)),
             r AS (SELECT user_id, ts, sum(broken::INT) OVER (PARTITION BY user_id ORDER BY ts DESC ROWS UNBOUNDED PRECEDING) AS breaks FROM g)
        SELECT user_id, CASE WHEN (epoch_us(TIMESTAMP '2024-01-30') - epoch_us(max(ts))) / 1e6 <= 604800 THEN sum((breaks = 0)::INT) ELSE 0 END::BIGINT AS streak FROM r GROUP BY user_id"""),
    "q_momentum": Query(momentum, """
        SELECT event_type, count(*) FILTER (ts >= TIMESTAMP '2024-01-20') AS today, count(*) FILTER (ts >= TIMESTAMP '2024-01-19 12:00:00') AS last_day, max(ts) AS latest, count(*) AS total
        FROM events WHERE ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY event_type"""),
    "q_json_usage_rollup": Query(usage, """
        WITH e AS (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
        SELECT event_type, sum(k)::BIGINT AS tokens, count(k) AS known, round(avg(k), 6) AS mean, (sum(k) * 100)::BIGINT AS credits FROM e GROUP BY event_type"""),
    "q_two_key_dedup": Query(two_keys, f"""
        WITH RECURSIVE o AS (SELECT o_custkey AS owner, o_orderkey AS place, o_orderstatus AS k1, o_orderpriority AS k2 FROM orders UNION ALL SELECT -1, place, k1, k2 FROM {values(DEDUP, 'place, k1, k2')}),
        r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY place) AS i FROM o),
        s AS (SELECT DISTINCT owner, 0::BIGINT AS i, 0::BIGINT AS place, ''::VARCHAR AS k1, ''::VARCHAR AS k2, false AS kept, []::VARCHAR[] AS a, []::VARCHAR[] AS b FROM r
              UNION ALL
              SELECT r.owner, r.i, r.place, r.k1, r.k2, NOT (list_contains(s.a, r.k1) OR list_contains(s.b, r.k2)),
                     CASE WHEN list_contains(s.a, r.k1) OR list_contains(s.b, r.k2) THEN s.a ELSE list_append(s.a, r.k1) END, CASE WHEN list_contains(s.a, r.k1) OR list_contains(s.b, r.k2) THEN s.b ELSE list_append(s.b, r.k2) END
              FROM s JOIN r ON r.owner = s.owner AND r.i = s.i + 1)
        SELECT owner, place, k1 AS queue_id, k2 AS bvid FROM s WHERE kept"""),
    "q_session_gaps": Query(gaps, """
        WITH g AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
             s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g)
        SELECT user_id, session, count(*) AS events, min(ts) AS start, max(ts) AS "end" FROM s GROUP BY user_id, session"""),
}
