"""Queries over the order, customer and conversation tables: joins, upserts, packing, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..operators import packing, relational, trees
from .query import Query, table, values

DURATIONS = [(1, "1:02:03"), (2, "5:xx"), (3, ""), (4, "90"), (5, None), (6, "0:59"), (7, "100:00:01"), (8, "1::3")]


def entries(spark: SparkSession, d: str) -> DataFrame:
    at = (F.col("turn") * 10).cast("double")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", "text", at.alias("from"), (at + 10).alias("to"))


PACK = r"""
    WITH RECURSIVE e AS (SELECT conv_id, {strip} AS text, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE length({strip}) > 0),
    p AS (SELECT conv_id, i, turn, 1 AS pack, length(text) AS held FROM e WHERE i = 1
          UNION ALL SELECT e.conv_id, e.i, e.turn, p.pack + (p.held + length(e.text) > {n})::INT, CASE WHEN p.held + length(e.text) > {n} THEN length(e.text) ELSE p.held + length(e.text) END
          FROM p JOIN e ON e.conv_id = p.conv_id AND e.i = p.i + 1)
    SELECT conv_id, pack::INT AS pack, count(*) AS entries, min(e.turn * 10)::DOUBLE AS start, max(e.turn * 10 + 10)::DOUBLE AS "end", sum(length(text))::BIGINT AS chars
    FROM p JOIN e USING (conv_id, i) GROUP BY conv_id, pack"""


PACK_TEXT = rf"""
    WITH RECURSIVE e AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '^{X._ENDS}|{X._ENDS}$', '', 'g') AS text FROM conversations),
    u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM e WHERE length(text) > 0),
    p AS (SELECT conv_id, i, 1 AS pack, length(text) AS held FROM u WHERE i = 1
          UNION ALL SELECT u.conv_id, u.i, p.pack + (p.held + length(u.text) > 1200)::INT, CASE WHEN p.held + length(u.text) > 1200 THEN length(u.text) ELSE p.held + length(u.text) END
          FROM p JOIN u ON u.conv_id = p.conv_id AND u.i = p.i + 1)
    SELECT conv_id, pack::INT AS pack, sha1(regexp_replace(string_agg(text, ' ' ORDER BY i), '[ \t]+', ' ', 'g')) AS text_sha1, min(turn * 10)::DOUBLE AS start, max(turn * 10 + 10)::DOUBLE AS "end", count(*) AS entries
    FROM p JOIN u USING (conv_id, i) GROUP BY conv_id, pack"""


def entry_pack(spark: SparkSession, d: str) -> DataFrame:
    rows = entries(spark, d)
    packed = packing.greedy_pack(rows.withColumn("t", X.strip(F.col("text"))), ["conv_id"], "turn", F.length("t"), 900)
    return packed.groupBy("conv_id", "pack").agg(F.count("*").alias("entries"), F.min("from").alias("start"), F.max("to").alias("end"), F.sum(F.length("t")).cast("long").alias("chars"))


def pack_text(spark: SparkSession, d: str) -> DataFrame:
    out = packing.pack_entries(entries(spark, d), "conv_id", "turn", "text", "from", "to", 1200)
    return out.select("conv_id", "pack", F.sha1("text").alias("text_sha1"), "start", "end", "entries")


def plain_timing(spark: SparkSession, d: str) -> DataFrame:
    """Time shared out by length: entries of a conversation over 600 seconds, the last ending exactly there."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = entries(spark, d).withColumn("n", F.length("text"))
    total, upto = F.sum("n").over(Window.partitionBy("conv_id")), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("conv_id", "turn", F.round(600.0 * (upto - F.col("n")) / total, 6).alias("start"), F.round(600.0 * upto / total, 6).alias("end"))


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return entries(spark, d).select("conv_id", "turn", F.right(F.lag("text").over(w), F.lit(40)).alias("previous_tail"), F.left(F.lead("text").over(w), F.lit(40)).alias("next_head"))


def known_anti(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    known = relational.unknown_rows(
        orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey",
        table(spark, d, "lineitem").where("l_quantity > 40").select("l_orderkey"), orders.where("o_orderstatus = 'F'").select("o_orderkey"),
    )
    return known.groupBy("o_custkey").agg(F.count("*").alias("unknown"), F.max("o_orderkey").alias("newest"))


def or_join(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").alias("by_key"), (F.col("s_nationkey") + 100).cast("long").alias("by_nation"))
    right = table(spark, d, "customer").select(F.col("c_custkey"), F.col("c_custkey").alias("position"))
    out = relational.first_match(left, right, [("by_key", "c_custkey"), ("by_nation", "c_custkey")], "s_suppkey", "position")
    return out.select("s_suppkey", F.col("position").alias("first_position"))


def registry_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots of orders merged by key: empty text falls back, zero does not, status stays."""
    orders = table(spark, d, "orders")
    row = lambda x: x.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("title"), F.col("o_totalprice").alias("views"))
    old = row(orders.where("o_orderdate < '1997-01-01'"))
    new = row(orders.where("o_orderdate >= '1995-01-01'")).select("id", F.lit("fetched").alias("status"), F.when(F.col("id") % 4 == 0, "").otherwise(F.upper("title")).alias("title"), F.when(F.col("id") % 8 == 0, 0.0).otherwise(F.col("views")).alias("views"))
    out = relational.upsert(old, new, "id", keep=["status"], filled=["title"], plain=["views"])
    return out.groupBy("status", "title").agg(F.count("*").alias("n"), F.round(F.sum("views"), 2).alias("views"), F.min("id").alias("first_id"))


def reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Pinned sources with stored state: state kept, name renewed, absent ones pruned, positions closed up over all sources.

    Positions come in two levels, over ranges of (priority, id) and within one, so that no task orders all sources.
    """
    customer = table(spark, d, "customer")
    pinned = customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("mid"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("group"))
    stored = customer.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("mid"), (F.col("c_custkey") % 97).alias("priority"))
    rows = pinned.join(stored, "mid", "left").withColumns({"fresh": F.col("priority").isNull(), "rank": F.coalesce("priority", F.lit(10**9)), "part": F.floor(F.col("mid") / 10_000)})
    before = F.sum("n").over(Window.orderBy("rank", "part").rowsBetween(Window.unboundedPreceding, -1))
    bases = rows.groupBy("rank", "part").agg(F.count("*").alias("n")).select("rank", "part", F.coalesce(before, F.lit(0)).alias("base"))  # a row a range
    place = F.row_number().over(Window.partitionBy("rank", "part").orderBy("mid")) - 1
    return rows.withColumn("place", place).join(bases, ["rank", "part"]).select("mid", "name", "group", (F.col("base") + F.col("place")).alias("priority"), "fresh")


def creator_groups(spark: SparkSession, d: str) -> DataFrame:
    """Orders per pinned creator (empty groups stay); the rest is one group of its own."""
    pinned = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    orders = table(spark, d, "orders").select("o_custkey", "o_orderdate")
    own = pinned.join(orders, pinned.c_custkey == orders.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_custkey").alias("records"), F.max("o_orderdate").alias("latest"))
    rest = orders.join(pinned, pinned.c_custkey == orders.o_custkey, "left_anti").agg(F.lit(-1).cast("long").alias("c_custkey"), F.count("*").alias("records"), F.max("o_orderdate").alias("latest"))
    return own.unionByName(rest)


def full_outer(spark: SparkSession, d: str) -> DataFrame:
    queue = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderkey").alias("queued"))
    seen = table(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.max("event_id").alias("seen"))
    return queue.join(seen, "key", "full").select("key", "queued", "seen", F.when(F.col("seen").isNull(), "waiting").when(F.col("queued").isNull(), "archived").otherwise("both").alias("state"))


PRESETS = [(0, "steel"), (1, "brass"), (2, "promo"), (3, "e")]


def containment(spark: SparkSession, d: str) -> DataFrame:
    """First preset (a short fixed list) that a part type contains, ignoring case."""
    kind = F.lower("p_type")
    pick = F.coalesce(*(F.when(F.contains(kind, F.lit(k)), i) for i, k in PRESETS))
    return table(spark, d, "part").select("p_partkey", pick.alias("preset"))


def top_per_creator(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return relational.top_per_group(docs, ["source"], [F.desc("n_chars"), F.col("doc_id")], 3)


def page_slice(spark: SparkSession, d: str) -> DataFrame:
    return relational.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 50, 7)


def archive_stats(spark: SparkSession, d: str) -> DataFrame:
    o, as_of = table(spark, d, "orders"), F.lit("1998-01-01").cast("timestamp_ntz")
    week = (F.col("o_orderdate") >= as_of - F.expr("INTERVAL 7 DAYS")) & (F.col("o_orderdate") <= as_of)
    return o.agg(
        F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus") == "O").alias("open"),
        F.count_if(week).alias("week"), F.round(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0)), 2).alias("value"),
        F.max("o_orderdate").alias("latest"), F.count_distinct("o_custkey").alias("creators"),
    )


def durations(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(-i, x) for i, x in DURATIONS], "id long, text string")
    own = F.concat_ws(":", (F.col("o_custkey") % 60).cast("string"), (F.col("o_orderkey") % 60).cast("string"))
    rows = rows.unionByName(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), own.alias("text")))
    seconds = N.duration_seconds(F.col("text"))
    return rows.select("id", seconds.alias("seconds"), N.clock(seconds).alias("clock"))


def epochs(spark: SparkSession, d: str) -> DataFrame:
    at = N.seconds(F.col("o_orderdate"))
    value = F.when(F.col("o_orderkey") % 2 == 0, at).otherwise(at * 1000)
    return table(spark, d, "orders").select("o_orderkey", N.epoch_guess(value).alias("ms"), N.epoch_to_iso(F.when(F.col("o_orderkey") % 5 == 0, F.lit(0)).otherwise(at)).alias("iso"))


def credit(spark: SparkSession, d: str) -> DataFrame:
    row = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 3 == 0, 0.0).otherwise(F.col("l_quantity")).alias("i"), F.when(F.col("l_linenumber") % 3 == 0, -1.0).otherwise(F.col("l_tax") * 100).alias("o"), F.col("l_quantity").alias("t"))
    return row.select("l_orderkey", N.credits(F.col("i"), F.col("o"), F.col("t")).alias("c")).groupBy("l_orderkey").agg(F.sum("c").alias("credits"))


def geography(spark: SparkSession, d: str) -> DataFrame:
    """Leaves below each node of the tree region - nation - supplier."""
    node = lambda t, i, p: t.select(i.alias("id"), p.alias("parent"))
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    nodes = node(table(spark, d, "region"), key("r", "r_regionkey"), F.lit(None).cast("string"))
    nodes = nodes.unionByName(node(table(spark, d, "nation"), key("n", "n_nationkey"), key("r", "n_regionkey")))
    nodes = nodes.unionByName(node(table(spark, d, "supplier"), key("s", "s_suppkey"), key("n", "s_nationkey")))
    up = trees.ancestors(nodes, 2).where("id like 's%' and distance > 0")
    return up.groupBy("ancestor").agg(F.count("*").alias("leaves"), F.max("distance").alias("depth"))


QUERIES = {
    "q_entry_pack": Query(entry_pack, PACK.format(n=900, strip=f"regexp_replace(coalesce(text, ''), '^{X._ENDS}|{X._ENDS}$', '', 'g')")),
    "q_pack_text": Query(pack_text, PACK_TEXT),
    "q_plain_text_timing": Query(plain_timing, """
        SELECT conv_id, turn, round(600.0::DOUBLE * (sum(length(text)) OVER w - length(text)) / sum(length(text)) OVER (PARTITION BY conv_id), 6) AS start,
               round(600.0::DOUBLE * sum(length(text)) OVER w / sum(length(text)) OVER (PARTITION BY conv_id), 6) AS "end"
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)"""),
    "q_chunk_context": Query(neighbours, """
        SELECT conv_id, turn, right(lag(text) OVER w, 40) AS previous_tail, left(lead(text) OVER w, 40) AS next_head FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""),
    "q_known_anti_join": Query(known_anti, """
        SELECT o_custkey, count(*) AS unknown, max(o_orderkey) AS newest FROM orders
        WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40) AND o_orderstatus <> 'F' GROUP BY o_custkey"""),
    "q_or_join_first": Query(or_join, """
        SELECT s_suppkey, (SELECT min(c_custkey) FROM customer WHERE c_custkey = s_suppkey OR c_custkey = s_nationkey + 100) AS first_position FROM supplier"""),
    "q_registry_upsert": Query(registry_upsert, """
        WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS title, o_totalprice AS views FROM orders WHERE o_orderdate < '1997-01-01'),
             n AS (SELECT o_orderkey AS id, 'fetched' AS status, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE upper(o_orderpriority) END AS title, CASE WHEN o_orderkey % 8 = 0 THEN 0.0 ELSE o_totalprice END AS views FROM orders WHERE o_orderdate >= '1995-01-01'),
             m AS (SELECT coalesce(o.id, n.id) AS id, coalesce(o.status, n.status) AS status, coalesce(nullif(n.title, ''), o.title, n.title) AS title, coalesce(n.views, o.views) AS views FROM o FULL JOIN n ON o.id = n.id)
        SELECT status, title, count(*) AS n, round(sum(views), 2) AS views, min(id) AS first_id FROM m GROUP BY status, title"""),
    "q_reconcile_sources": Query(reconcile, """
        WITH s AS (SELECT c_custkey, c_custkey % 97 AS priority FROM customer WHERE c_mktsegment <> 'BUILDING')
        SELECT c.c_custkey AS mid, c_name AS name, c_nationkey AS "group", row_number() OVER (ORDER BY coalesce(s.priority, 1000000000), c.c_custkey) - 1 AS priority, s.priority IS NULL AS fresh
        FROM customer c LEFT JOIN s ON s.c_custkey = c.c_custkey WHERE c_acctbal > 0"""),
    "q_archive_groups": Query(creator_groups, """
        WITH p AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
        SELECT c_custkey, count(o_custkey) AS records, max(o_orderdate) AS latest FROM p LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
        UNION ALL SELECT -1, count(*), max(o_orderdate) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM p)"""),
    "q_workbench_full_outer": Query(full_outer, """
        WITH q AS (SELECT o_custkey AS key, max(o_orderkey) AS queued FROM orders GROUP BY 1), e AS (SELECT user_id AS key, max(event_id) AS seen FROM events GROUP BY 1)
        SELECT coalesce(q.key, e.key) AS key, queued, seen, CASE WHEN seen IS NULL THEN 'waiting' WHEN queued IS NULL THEN 'archived' ELSE 'both' END AS state FROM q FULL JOIN e ON q.key = e.key"""),
    "q_profile_containment": Query(containment, f"""
        SELECT p_partkey, (SELECT min(i) FROM {values(PRESETS, 'i, k')} WHERE contains(lower(p_type), k))::INT AS preset FROM part"""),
    "q_topn_per_creator": Query(top_per_creator, """
        SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INT AS rank FROM documents QUALIFY rank <= 3"""),
    "q_page_slice": Query(page_slice, """
        WITH t AS (SELECT greatest(1, least(7, (count(*) + 49) // 50))::INT AS page FROM orders),
             r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders)
        SELECT o_orderkey, o_totalprice, page FROM r, t WHERE i > (page - 1) * 50 AND i <= page * 50"""),
    "q_archive_stats": Query(archive_stats, """
        SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS open,
               count(*) FILTER (o_orderdate BETWEEN TIMESTAMP '1997-12-25' AND TIMESTAMP '1998-01-01') AS week,
               round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS value, max(o_orderdate) AS latest, count(DISTINCT o_custkey) AS creators FROM orders"""),
    "q_duration_parse": Query(durations, """
        SELECT * FROM (VALUES (-1, 3723.0::DOUBLE, '01:02:03'), (-2, 0.0, '00:00'), (-3, 0.0, '00:00'), (-4, 90.0, '01:30'), (-5, 0.0, '00:00'), (-6, 59.0, '00:59'), (-7, 360001.0, '100:00:01'), (-8, 3603.0, '01:00:03')) AS v(id, seconds, clock)
        UNION ALL SELECT o_orderkey, (o_custkey % 60) * 60.0 + o_orderkey % 60, printf('%02d:%02d', o_custkey % 60, o_orderkey % 60) FROM orders"""),
    "q_epoch_heuristic": Query(epochs, """
        SELECT o_orderkey, epoch(o_orderdate)::BIGINT * 1000 AS ms, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') END AS iso FROM orders"""),
    "q_credit_estimate": Query(credit, """
        SELECT l_orderkey, sum(CASE WHEN l_linenumber % 3 = 0 THEN round(l_quantity * 100) ELSE round(l_quantity * 100 + l_tax * 100 * 200) END)::BIGINT AS credits FROM lineitem GROUP BY l_orderkey"""),
    "q_tree_leaves": Query(geography, """
        SELECT 'n' || s_nationkey AS ancestor, count(*) AS leaves, 1 AS depth FROM supplier GROUP BY 1
        UNION ALL SELECT 'r' || n_regionkey, count(*), 2 FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1"""),
}
