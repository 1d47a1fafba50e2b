"""Queries over courses: cleaning chunks, chapter groups, trees with dependencies, runs to reuse, retries as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking, packing, relational, trees
from ..sources.places import new_path
from ..streaming import retries, tables
from .packages import stream_of
from .query import Query, table

CHUNK = 1500


def cleaning(spark: SparkSession, d: str) -> DataFrame:
    """Turns as timed units under part labels; users' turns have no start, the last of three no end, the first three no label."""
    at, part = (F.col("turn") * 10).cast("double"), F.floor(F.col("turn") / 3)
    units = table(spark, d, "conversations").select(
        "conv_id", "turn", "text", F.when(part > 0, F.concat(F.lit("P"), part.cast("string"))).otherwise("").alias("label"),
        F.when(F.col("role") != "user", at).alias("from"), F.when(F.col("turn") % 3 < 2, at + 10).alias("to"),
    )
    out = packing.cleaning_chunks(units, "conv_id", "turn", "text", "label", "from", "to", CHUNK)
    return out.select("conv_id", "chunk", F.sha1("text").alias("text_sha1"), F.array_join("labels", "|").alias("labels"), "start", "end", F.sha1("previous_tail").alias("tail_sha1"), F.sha1("next_head").alias("head_sha1"))


def chapters(spark: SparkSession, d: str) -> DataFrame:
    """A user's days as chapters, the events of a day as their lessons."""
    days = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("lessons"))
    return chunking.chapter_groups(days, ["user_id"], "day", "lessons")


def course(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tree region - nation - supplier with places, each node after its sibling before it, and the completed suppliers."""
    node = lambda t, i, p, leaf, *at: t.select(i.alias("id"), p.alias("parent"), F.lit(leaf).alias("study"), *(a.alias(n) for a, n in zip(at, "abc", strict=True)))
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    none, nation = F.lit(-1).cast("long"), table(spark, d, "nation")
    supplier = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    r, n, s = (F.col(c).cast("long") for c in ("n_regionkey", "n_nationkey", "s_suppkey"))
    nodes = node(table(spark, d, "region"), key("r", "r_regionkey"), F.lit(None).cast("string"), False, F.col("r_regionkey").cast("long"), none, none)
    nodes = nodes.unionByName(node(nation, key("n", "n_nationkey"), key("r", "n_regionkey"), False, r, n, none))
    nodes = nodes.unionByName(node(supplier, key("s", "s_suppkey"), key("n", "s_nationkey"), True, r, n, s))
    needs = nodes.select("id", F.lag("id").over(Window.partitionBy("parent").orderBy("a", "b", "c")).alias("needs")).where("needs is not null")
    done = supplier.where("s_acctbal > 4000 * n_regionkey - 2000").select(key("s", "s_suppkey").alias("id"))
    return nodes, needs, done


def unlock(spark: SparkSession, d: str) -> DataFrame:
    return trees.met(*course(spark, d), depth=2)


def reach(spark: SparkSession, d: str) -> DataFrame:
    """Every node: whether it can be reached, is unlocked, and is the one to study next."""
    nodes, needs, done = course(spark, d)
    order = [F.col(c) for c in "abc"]
    flag = lambda rows, name: rows.withColumn(name, F.lit(True))
    out = trees.reachable(nodes, needs, done, 2)
    out = out.join(flag(trees.unlocked(nodes, needs, done, order, "study", 2), "unlocked"), "id", "left")
    out = out.join(flag(trees.next_leaf(nodes, needs, done, order, "study", 2), "next"), "id", "left")
    return out.select("id", "reachable", F.coalesce("unlocked", F.lit(False)).alias("unlocked"), F.coalesce("next", F.lit(False)).alias("next"))


def celebrate(spark: SparkSession, d: str) -> DataFrame:
    """Countries as stages, their suppliers as leaves: stages that the suppliers in the black complete, beyond the rich ones."""
    supplier = table(spark, d, "supplier")
    name = lambda c: F.concat(F.lit("s"), F.col(c).cast("string"))
    leaves = supplier.select(name("s_suppkey").alias("id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("parent"))
    nodes = leaves.unionByName(leaves.select(F.col("parent").alias("id"), F.lit(None).cast("string").alias("parent")).distinct())
    some = lambda rule: supplier.where(rule).select(name("s_suppkey").alias("id"))
    return trees.celebrations(nodes, some("s_acctbal > 6000"), some("s_acctbal > 0"), depth=1)


def reuse(spark: SparkSession, d: str) -> DataFrame:
    """Lines as artifacts of an order's run; they are stored once shipped, and in order unless returned."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_shipdate")
    stored = lines.where("l_shipdate < '1997-06-01'").withColumn("fine", F.col("l_returnflag") != "R")
    return relational.reusable(lines, stored, "l_orderkey", "l_linenumber", "l_partkey", "fine").groupBy("reusable").agg(F.count("*").alias("orders"), F.sum("l_orderkey").alias("keys"))


def changed(spark: SparkSession, d: str) -> DataFrame:
    """Customers to write again: those in debt get another segment, one segment was not stored yet."""
    old = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = table(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_acctbal") < 0, "DEBT").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return relational.changed_rows(new, old.where("c_mktsegment <> 'BUILDING'"), "c_custkey")


def stream_retries(spark: SparkSession, d: str) -> DataFrame:
    """A user as a queued item, each event as the outcome of a run."""
    path = new_path(spark, "retries")
    outcome = F.when(F.col("event_type") == "view", "ok").when(F.col("event_type") == "signup", "config").when(F.col("event_type") == "error", "hopeless").otherwise("fault")
    outcomes = stream_of(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("at"), outcome.alias("outcome"))
    tables.run(retries.advance(outcomes), f"{path}-state", tables.to_versions(path), "update")
    return tables.newest(spark, path, ["id"])


def year_support(spark: SparkSession, d: str) -> DataFrame:
    """Years of shipping that the year of the order does not support."""
    shipped = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.date_format("l_shipdate", "yyyy"))), "年 ").alias("cleaned"))
    rows = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy年").alias("source")).join(shipped, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select("o_orderkey", F.regexp_replace(F.array_join(X.unsupported_years(F.col("source"), F.col("cleaned")), "|"), "年", "").alias("result"))


def years_softened(spark: SparkSession, d: str) -> DataFrame:
    """Shipping notes of all lines; the order tells the year, for every third line with its first digit lost."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    year = F.year("l_shipdate").cast("string")
    source = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("在"), F.substring(year, 2, 3), F.lit("年"))).otherwise(F.concat(F.year("o_orderdate").cast("string"), F.lit("年下单")))
    note = F.concat(F.date_format("l_shipdate", "yyyy年M月d日"), F.lit("星期三发货，"), year, F.lit("年收到，编号"), year, F.lit("5，"), year, F.lit(" 与 v"), year, F.lit(".0"))
    return rows.select("l_orderkey", "l_linenumber", X.soften_years(source, note).alias("note"))


def marker_loss(spark: SparkSession, d: str) -> DataFrame:
    """Time markers of all turns that those of the assistant's turns lack."""
    at = F.format_string("[00:%02d-00:%02d]", (F.col("turn") * 2).cast("int"), (F.col("turn") * 2 + 1).cast("int"))
    mark = lambda only: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(only, F.struct("turn", at.alias("m"))))), lambda x: x["m"]), " ")
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(mark(F.lit(True)).alias("source"), mark(F.col("role") == "assistant").alias("cleaned"))
    return rows.select("conv_id", F.array_join(X.missing_markers(F.col("source"), F.col("cleaned")), "|").alias("result"))


COURSE = """
    s AS (SELECT s_suppkey AS k, n_nationkey AS n, n_regionkey AS r, s_acctbal > 4000 * n_regionkey - 2000 AS done FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    n AS (SELECT n_nationkey AS n, n_regionkey AS r, coalesce(bool_and(done), false) AS whole FROM nation LEFT JOIN s ON s.n = n_nationkey GROUP BY 1, 2),
    r AS (SELECT r_regionkey AS r, coalesce(bool_and(whole), false) AS whole FROM region LEFT JOIN n ON n.r = r_regionkey GROUP BY 1),
    rm AS (SELECT r, coalesce(lag(whole) OVER (ORDER BY r), true) AS met FROM r),
    nm AS (SELECT n, r, coalesce(lag(whole) OVER (PARTITION BY r ORDER BY n), true) AS met FROM n),
    sm AS (SELECT k, n, r, done, coalesce(lag(done) OVER (PARTITION BY n ORDER BY k), true) AS met FROM s)"""

QUERIES = {
    "q_cleaning_chunks_context": Query(cleaning, f"""
        WITH RECURSIVE e AS (
          SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '^{X._ENDS}|{X._ENDS}$', '', 'g') AS text, CASE WHEN turn >= 3 THEN 'P' || turn // 3 ELSE '' END AS label,
                 CASE WHEN role <> 'user' THEN turn * 10 END::DOUBLE AS f, CASE WHEN turn % 3 < 2 THEN turn * 10 + 10 END::DOUBLE AS t FROM conversations),
        u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM e WHERE length(text) > 0),
        p AS (SELECT conv_id, i, 1 AS chunk, length(text) AS held FROM u WHERE i = 1
              UNION ALL SELECT u.conv_id, u.i, p.chunk + (p.held + length(u.text) > {CHUNK})::INT, CASE WHEN p.held + length(u.text) > {CHUNK} THEN length(u.text) ELSE p.held + length(u.text) END
              FROM p JOIN u ON u.conv_id = p.conv_id AND u.i = p.i + 1),
        c AS (SELECT conv_id, chunk, i, turn, label, f, t, text, lag(label, 1, '') OVER (PARTITION BY conv_id, chunk ORDER BY i) AS above FROM p JOIN u USING (conv_id, i)),
        l AS (SELECT *, CASE WHEN label <> '' AND label <> above THEN chr(10) || '## ' || label || chr(10) ELSE '' END
                     || CASE WHEN f IS NULL AND t IS NULL THEN '' ELSE '[' || coalesce(printf('%02d:%02d', f::INT // 60, f::INT % 60), '?') || '-' || coalesce(printf('%02d:%02d', t::INT // 60, t::INT % 60), '?') || '] ' END || text AS line FROM c),
        b AS (SELECT conv_id, chunk, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^{X._ENDS}|{X._ENDS}$', '', 'g') AS text, string_agg(CASE WHEN label <> '' AND label <> above THEN label END, '|' ORDER BY i) AS labels, min(f) AS start, max(t) AS "end" FROM l GROUP BY conv_id, chunk)
        SELECT conv_id, chunk::INT AS chunk, sha1(text) AS text_sha1, coalesce(labels, '') AS labels, start, "end", sha1(coalesce(right(lag(text) OVER w, 700), '')) AS tail_sha1, sha1(coalesce(left(lead(text) OVER w, 700), '')) AS head_sha1
        FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY chunk)"""),
    "q_chapter_groups": Query(chapters, """
        WITH RECURSIVE c AS (SELECT user_id, ts::DATE AS day, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts::DATE)::INT AS i, count(*) OVER (PARTITION BY user_id) AS days FROM events GROUP BY 1, 2),
        s AS (SELECT user_id, 0 AS i, 0 AS root, 0 AS waiting, 0::BIGINT AS held FROM c WHERE i = 1
              UNION ALL
              SELECT user_id, i, CASE WHEN waiting > 0 AND NOT alone THEN root ELSE root + 1 END, CASE WHEN shut THEN 0 ELSE waiting + 1 END::INT, CASE WHEN shut THEN 0 ELSE held END::BIGINT
              FROM (SELECT *, n > 2 AND waiting > 1 AND held > 8 AS alone, CASE WHEN n > 2 THEN true ELSE waiting >= 1 AND held >= 8 END AS shut
                    FROM (SELECT s.user_id, c.i, s.root, s.waiting, s.held + c.n AS held, c.n FROM s JOIN c ON c.user_id = s.user_id AND c.i = s.i + 1))),
        g AS (SELECT user_id, i, CASE WHEN days <= 24 THEN i ELSE root END AS root FROM s JOIN c USING (user_id, i)),
        m AS (SELECT *, max(root) OVER (PARTITION BY user_id) AS roots FROM g)
        SELECT user_id, CASE WHEN roots <= 24 THEN root ELSE (root - 1) // greatest(2, ceil(roots / 24))::INT + 1 END::INT AS root, min(i)::INT AS first, max(i)::INT AS last FROM m GROUP BY 1, 2"""),
    "q_tree_unlock": Query(unlock, f"WITH {COURSE} SELECT 'r' || r AS id, met FROM rm UNION ALL SELECT 'n' || n, met FROM nm UNION ALL SELECT 's' || k, met FROM sm"),
    "q_tree_reach": Query(reach, f"""
        WITH {COURSE},
        o AS (SELECT k, n, r, done, sm.met AND nm.met AND rm.met AS reach FROM sm JOIN nm USING (n, r) JOIN rm USING (r)),
        x AS (SELECT * FROM o WHERE reach AND NOT done ORDER BY r, n, k LIMIT 1),
        u AS (SELECT k, n, r FROM o WHERE done UNION SELECT k, n, r FROM x)
        SELECT 'r' || r AS id, met AS reachable, r IN (SELECT r FROM u) AS unlocked, false AS next FROM rm
        UNION ALL SELECT 'n' || n, nm.met AND rm.met, n IN (SELECT n FROM u), false FROM nm JOIN rm USING (r)
        UNION ALL SELECT 's' || k, reach, k IN (SELECT k FROM u), k IN (SELECT k FROM x) FROM o"""),
    "q_stage_celebration": Query(celebrate, """
        SELECT 'n' || s_nationkey AS stage, count(*) AS total, count(*) FILTER (s_acctbal > 0) AS done FROM supplier GROUP BY s_nationkey HAVING min(s_acctbal) > 0 AND min(s_acctbal) <= 6000"""),
    "q_reusable_runs": Query(reuse, """
        WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_shipdate < '1997-06-01' AND l_returnflag <> 'R'),
             o AS (SELECT l_orderkey, bool_and((l_orderkey, l_linenumber, l_partkey) IN (SELECT (l_orderkey, l_linenumber, l_partkey) FROM r)) AS reusable FROM lineitem GROUP BY l_orderkey)
        SELECT reusable, count(*) AS orders, sum(l_orderkey)::BIGINT AS keys FROM o GROUP BY reusable"""),
    "q_changed_rows": Query(changed, "SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING'"),
    "q_stream_retries": Query(stream_retries, """
        WITH e AS (SELECT user_id AS id, event_id AS k, event_type AS t, count(*) FILTER (event_type NOT IN ('view', 'signup', 'error')) OVER (PARTITION BY user_id ORDER BY event_id) AS faults FROM events),
             f AS (SELECT id, min(k) AS k FROM e WHERE t IN ('view', 'signup', 'error') OR faults >= 4 GROUP BY id),
             n AS (SELECT id, max(faults) AS most FROM e GROUP BY id)
        SELECT n.id, CASE WHEN f.k IS NULL THEN 'queued' WHEN t = 'view' THEN 'done' WHEN t = 'error' THEN 'skipped' ELSE 'failed' END AS status, least(3, coalesce(e.faults, most)) AS retries,
               CASE WHEN f.k IS NULL OR t = 'signup' THEN [0, 300000, 1800000, 7200000][least(3, coalesce(e.faults, most)) + 1] ELSE 0 END::BIGINT AS wait_ms
        FROM n LEFT JOIN f ON f.id = n.id LEFT JOIN e ON e.id = f.id AND e.k = f.k"""),
    "q_years_softened": Query(years_softened, """
        WITH n AS (SELECT l_orderkey, l_linenumber, l_linenumber % 3 = 0 OR year(l_shipdate) = year(o_orderdate) AS known, year(l_shipdate)::VARCHAR AS y, month(l_shipdate) || '月' || day(l_shipdate) || '日' AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
        SELECT l_orderkey, l_linenumber, CASE WHEN known THEN y || '年' || day || '星期三发货，' || y || '年收到，编号' || y || '5，' || y || ' 与 v' || y || '.0'
               ELSE day || '发货，当时收到，编号' || y || '5，当时 与 v当时.0' END AS note FROM n"""),
    "q_year_support": Query(year_support, """
        SELECT o_orderkey, coalesce(string_agg(DISTINCT year(l_shipdate)::VARCHAR, '|' ORDER BY year(l_shipdate)::VARCHAR) FILTER (year(l_shipdate) <> year(o_orderdate)), '') AS result
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"""),
    "q_missing_markers": Query(marker_loss, """
        SELECT conv_id, CASE WHEN count(*) < 2 THEN '' ELSE coalesce(string_agg(CASE WHEN role <> 'assistant' THEN printf('[00:%02d-00:%02d]', turn * 2, turn * 2 + 1) END, '|' ORDER BY turn), '') END AS result
        FROM conversations GROUP BY conv_id"""),
}
