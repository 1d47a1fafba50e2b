"""Queries with timers, lifetimes and interval joins over streams, paged backfill and run states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import runs
from ..sources.places import new_path, stage
from ..streaming import tables, timers
from .query import Query, table

FAR = "2100-01-01"
DELAYS = (6 * 3_600_000, 24 * 3_600_000, 72 * 3_600_000)


def landed(rows: DataFrame, path: str) -> DataFrame:
    rows.write.mode("append").parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(path)


def returning_items(spark: SparkSession, d: str) -> DataFrame:
    """Users as items, events as outcomes; waits are hours.  A row far in the future closes the log, in a second run from the same state."""
    path = new_path(spark, "returning")
    outcome = F.when(F.col("event_type") == "signup", "ok").when(F.col("event_type") == "purchase", "hopeless").otherwise("fault")
    at = N.micros(F.col("ts"))
    rows = table(spark, d, "events").select(F.col("user_id").alias("id"), F.floor(at / 1000).cast("long").alias("at"), outcome.alias("outcome"), F.timestamp_millis(F.floor(at / 1000)).alias("seen"))
    end = spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit(0).cast("long").alias("at"), F.lit("ok").alias("outcome"), F.lit(f"{FAR} 00:00:00").cast("timestamp").alias("seen"))
    with timers.rocksdb(spark):
        for more in (rows, end):
            stream = landed(more, f"{path}/landing")
            tables.run(timers.returning(stream, DELAYS, at="seen"), f"{path}/state", tables.to_versions(f"{path}/log"))
    return spark.read.parquet(f"{path}/log").where("id >= 0").groupBy("id", "what", "retries").agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("due").alias("last_due"))


_OUTCOME = "CASE event_type WHEN 'signup' THEN 'done' WHEN 'purchase' THEN 'skipped' ELSE 'fault' END"
RETURNING = f"""
    WITH RECURSIVE e AS (SELECT user_id AS id, epoch_us(ts) // 1000 AS t, {_OUTCOME} AS o, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, CASE event_type WHEN 'signup' THEN 'ok' WHEN 'purchase' THEN 'hopeless' ELSE 'fault' END) AS i FROM events),
    s AS (SELECT id, 0::BIGINT AS i, NULL::BIGINT AS t, 'queued' AS status, 0 AS retries, 0::BIGINT AS due, NULL::VARCHAR AS what, NULL::BIGINT AS back FROM e WHERE i = 1
          UNION ALL
          SELECT id, i, t, CASE WHEN what IS NULL THEN status ELSE what END, retries + (coalesce(what, '') = 'waiting')::INT, CASE WHEN what = 'waiting' THEN t + [{', '.join(map(str, DELAYS))}][retries + 1] ELSE due END, what, back
          FROM (SELECT id, i, t, CASE WHEN back IS NOT NULL THEN 'queued' ELSE status END AS status, retries, due, back,
                       CASE WHEN status = 'queued' OR back IS NOT NULL THEN CASE WHEN o <> 'fault' THEN o WHEN retries = 3 THEN 'failed' ELSE 'waiting' END END AS what
                FROM (SELECT s.id, e.i, e.t, e.o, s.status, s.retries, s.due, CASE WHEN s.status = 'waiting' AND s.due <= e.t THEN s.due END AS back FROM s JOIN e ON e.id = s.id AND e.i = s.i + 1))),
    l AS (SELECT id, what, t AS moment, retries, CASE WHEN what = 'waiting' THEN due END AS due FROM s WHERE what IS NOT NULL
          UNION ALL SELECT id, 'returned', due, retries, NULL FROM s WHERE what = 'waiting')
    SELECT id, what, retries, count(*) AS n, min(moment) AS first_at, max(due) AS last_due FROM l GROUP BY ALL"""


def cache_requests(events: DataFrame) -> DataFrame:
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0))
    fields = {"version": F.lit("v2"), "provider": F.when(k % 7 == 0, "a").otherwise("b"), "model": F.lit("m"), "language": F.when(k % 11 != 0, "zh"), "label": F.col("event_type"), "prompt": (k % 2).cast("string"), "signature": (k % 3).cast("string"), "offset": (k % 2).cast("string"), "chunk": (k % 3).cast("string")}
    return events.select("user_id", F.col("event_id").alias("request"), *(c.cast("string").alias(n) for n, c in fields.items()))


def cache_levels(spark: SparkSession, d: str) -> DataFrame:
    """Events as requests for the page of their user: what each level of the cache answers."""
    path = new_path(spark, "cached")
    with timers.rocksdb(spark):
        requests = cache_requests(tables.arrived(spark, d, table(spark, d, "events").schema, "events.parquet"))
        tables.run(timers.cached(requests, ["user_id"]), f"{path}/state", tables.to_versions(f"{path}/log"))
    return spark.read.parquet(f"{path}/log").groupBy("page", "chunk").agg(F.count("*").alias("n"), F.sum("request").alias("requests"))


def paused_activity(spark: SparkSession, d: str) -> DataFrame:
    """Each event that is no error with the errors of its user that pause it; an error pauses for 1 to 48 hours."""
    path = new_path(spark, "paused")
    e = table(spark, d, "events")
    hours = F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0)) % 48 + 1
    at = F.timestamp_micros(N.micros(F.col("ts")))
    activity = e.where("event_type <> 'error'").select("user_id", "event_id", at.alias("at"))
    pauses = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("pause"), at.alias("start"), F.timestamp_micros(N.micros(F.col("ts")) + hours * 3_600_000_000).alias("until"))
    end = F.lit(f"{FAR} 00:00:00").cast("timestamp")
    one = spark.range(1)
    last = (one.select(F.lit(-1).cast("long").alias("user_id"), F.lit(-1).cast("long").alias("event_id"), end.alias("at")), one.select(F.lit(-2).cast("long").alias("user_id"), F.lit(-2).cast("long").alias("pause"), end.alias("start"), end.alias("until")))
    for a, p in ((activity, pauses), last):
        streams = landed(a, f"{path}/activity"), landed(p, f"{path}/pauses")
        tables.run(timers.within(*streams, "user_id", "at", "start", "until", "49 hours", "1 hour"), f"{path}/state", tables.to_versions(f"{path}/log"))
    return spark.read.parquet(f"{path}/log").where("user_id >= 0").select("user_id", "event_id", "pause")


SIZE = 4


def backfill(spark: SparkSession, d: str) -> DataFrame:
    """Three pages of orders of each customer, then a stop, then two more from the cursors that were kept; every third total is unknown."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    totals = o.groupBy("o_custkey").agg(F.count("*").alias("total"))
    cursors = totals.select("o_custkey", F.lit(0).cast("long").alias("page"), F.lit(True).alias("more"), F.when(F.col("o_custkey") % 3 != 0, F.col("total")).alias("total"))
    order = [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]
    found = None
    for _ in range(5):
        rows, after = runs.next_pages(cursors, o, "o_custkey", order, SIZE)
        rows = rows.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))
        found = rows if found is None else found.unionByName(rows)
        cursors = stage(after, "cursors")
    sums = found.groupBy("o_custkey").agg(F.sum("n").alias("fetched"), F.sum("keys").alias("keys"))
    return cursors.join(sums, "o_custkey").select("o_custkey", "page", "more", "fetched", "keys")


def run_state(spark: SparkSession, d: str) -> DataFrame:
    """Events as patches of their user's run: the kind is the step, views and clicks are completed, errors take back what was viewed."""
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0))
    status = F.when(k % 5 == 0, "failed").when(k % 5 == 1, "needs_review").otherwise("ok")
    stage_ = runs.stage_of(status, F.when(k % 3 == 0, k % 2 == 0))
    kind = F.col("event_type")
    patches = table(spark, d, "events").select(
        "user_id", "event_id", F.when(k % 4 != 0, stage_).alias("stage"), F.when(kind != "signup", kind).alias("step"), status.alias("step_status"), F.when(kind.isin("view", "click"), kind).alias("add"), F.when(kind == "error", "view").alias("remove"))
    out = runs.run_states(patches, "user_id", "event_id")
    return out.select("user_id", "stage", F.array_join("completed", ",").alias("completed"), F.array_join("steps", ",").alias("steps"))


_K = "coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0)"
QUERIES = {
    "q_stream_returning": Query(returning_items, RETURNING),
    "q_stream_cache_levels": Query(cache_levels, f"""
        WITH r AS (SELECT user_id, event_id, (k % 7 = 0, k % 11 = 0, event_type, k % 2, k % 3) AS p, (k % 7 = 0, k % 11 = 0, k % 2, k % 3) AS c FROM (SELECT *, {_K} AS k FROM events)),
        l AS (SELECT *, lag(p) OVER (PARTITION BY user_id ORDER BY event_id) AS before, row_number() OVER (PARTITION BY user_id, c ORDER BY event_id) AS nth, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM r),
        a AS (SELECT event_id, CASE WHEN i = 1 THEN 'miss' WHEN before = p THEN 'hit' ELSE 'stale' END AS page, nth FROM l)
        SELECT page, CASE WHEN page <> 'hit' THEN CASE WHEN nth > 1 THEN 'hit' ELSE 'miss' END END AS chunk, count(*) AS n, sum(event_id)::BIGINT AS requests FROM a GROUP BY 1, 2"""),
    "q_stream_paused": Query(paused_activity, f"""
        WITH p AS (SELECT user_id, event_id AS pause, ts AS start, ts + to_hours(({_K} % 48 + 1)::INT) AS until FROM events WHERE event_type = 'error')
        SELECT e.user_id, e.event_id, p.pause FROM events e LEFT JOIN p ON p.user_id = e.user_id AND e.ts >= p.start AND e.ts < p.until WHERE e.event_type <> 'error'"""),
    "q_paged_backfill": Query(backfill, f"""
        WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS i, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders),
        c AS (SELECT o_custkey, any_value(total) AS total, CASE WHEN o_custkey % 3 <> 0 THEN any_value(total) END AS known, sum(o_orderkey) FILTER (i <= 5 * {SIZE})::BIGINT AS keys, count(*) FILTER (i <= 5 * {SIZE}) AS fetched FROM o GROUP BY o_custkey),
        e AS (SELECT *, CASE WHEN known IS NULL THEN total // {SIZE} + 1 ELSE greatest(1, (total + {SIZE} - 1) // {SIZE}) END AS last_page FROM c)
        SELECT o_custkey, least(5, last_page)::BIGINT AS page, last_page > 5 AS more, fetched, keys FROM e"""),
    "q_run_states": Query(run_state, f"""
        WITH p AS (SELECT *, CASE k % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'needs_review' ELSE 'ok' END AS st, CASE WHEN k % 3 = 0 THEN k % 2 = 0 ELSE true END AS fine FROM (SELECT user_id, event_id, event_type AS t, {_K} AS k FROM events)),
        g AS (SELECT user_id, arg_max(CASE WHEN st = 'ok' AND fine THEN '{runs.READY}' WHEN st <> 'failed' THEN '{runs.REVIEW}' ELSE '{runs.FAILED}' END, event_id) FILTER (k % 4 <> 0) AS stage FROM p GROUP BY 1),
        s AS (SELECT user_id, t, max(event_id) AS pos, arg_max(st, event_id) AS st FROM p WHERE t <> 'signup' GROUP BY 1, 2),
        r AS (SELECT user_id, max(event_id) AS gone FROM p WHERE t = 'error' GROUP BY 1),
        a AS (SELECT p.user_id, t, min(event_id) AS pos FROM p LEFT JOIN r ON r.user_id = p.user_id WHERE t = 'click' OR (t = 'view' AND (gone IS NULL OR event_id >= gone)) GROUP BY 1, 2)
        SELECT user_id, stage, coalesce((SELECT string_agg(t, ',' ORDER BY pos) FROM a WHERE a.user_id = g.user_id), '') AS completed, coalesce((SELECT string_agg(t || '=' || st, ',' ORDER BY pos) FROM s WHERE s.user_id = g.user_id), '') AS steps FROM g"""),
}
