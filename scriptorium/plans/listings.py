"""Queries over listings: documents as materials of suppliers, suppliers as followed sources; notes on orders as texts to mend."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks
from ..operators import listings
from .query import Query, quoted, table


def misc_materials(spark: SparkSession, d: str) -> DataFrame:
    """Materials that say "the" and belong to no supplier in debt; every fourth has no creator, every fifth no output."""
    s, k = table(spark, d, "supplier"), F.col("doc_id")
    docs = table(spark, d, "documents").withColumn("supplier", k % 10 + 1)
    rows = docs.join(s, F.col("supplier") == F.col("s_suppkey"), "left").select(
        "doc_id", F.col("text").alias("title"), F.when(k % 4 != 0, F.concat(F.lit(" 　"), F.upper("s_name"), F.lit("\t"))).alias("creator"), k.alias("source_id"), F.lit(None).cast("string").alias("source_url"), F.lit("done").alias("stage"), F.col("source").alias("text_source"),
        listings.read_path((k % 5 < 2, F.concat(F.lit("book/"), k.cast("string"))), (k % 5 == 2, F.lit("")), (k % 5 < 4, F.concat(F.lit("raw/"), k.cast("string")))).alias("read_path"),
    )
    pinned = s.where("s_acctbal < 2000").select(F.col("s_name").alias("name")).unionByName(spark.range(1).select(F.lit(" ").alias("name")))
    return listings.materials(rows, " The ", pinned=pinned).select("doc_id", "read_path")


def follow_sources(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers whose name, key or nation holds a 1, those in debt first."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    items = s.select(F.col("s_suppkey").alias("mid"), F.col("s_name").alias("name"), F.col("n_name").alias("sign"), F.lit(None).cast("string").alias("official_title"), F.col("s_suppkey").alias("position"))
    pinned = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("mid"))
    return listings.sources(items, pinned, "1").select("mid", "sign", "pinned")


def repair_notes(spark: SparkSession, d: str) -> DataFrame:
    """Orders as qualities of texts: lists by the order and its customer, the ratio from the price."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    some = lambda name, n: F.when(n > 0, F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.concat(F.lit(name), i.cast("string"))))
    notes = checks.repair_notes(some("T", o % 15), some("M", c % 14), some("Y", o % 3), F.col("o_totalprice") / 200000, some("S", c % 6), F.when(o % 2 == 0, 0.24))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(notes, "|").alias("notes"))


def _some(note: str, name: str, n: str, most: int, by: str) -> str:
    return f"CASE WHEN {n} > 0 THEN {quoted(note)} || array_to_string([{quoted(name)} || i FOR i IN range(1, least({n}, {most}) + 1)], {quoted(by)}) END"


QUERIES = {
    "q_repair_notes": Query(repair_notes, f"""
        SELECT o_orderkey, concat_ws('|', {_some(checks.NOTES[0], 'T', 'o_orderkey % 15', 12, ', ')}, {_some(checks.NOTES[1], 'M', 'o_custkey % 14', 12, ', ')}, {_some(checks.NOTES[2], 'Y', 'o_orderkey % 3', 12, ', ')},
               CASE WHEN o_totalprice / 200000 < CASE WHEN o_orderkey % 2 = 0 THEN 0.24::DOUBLE ELSE 0.72::DOUBLE END THEN {quoted(checks.NOTES[3])} END, CASE WHEN o_totalprice / 200000 > 1.45::DOUBLE THEN {quoted(checks.NOTES[4])} END,
               {_some(checks.NOTES[5], 'S', 'o_custkey % 6', 4, '；')}) AS notes FROM orders"""),
    "q_misc_materials": Query(misc_materials, """
        WITH r AS (SELECT doc_id, text, source, CASE WHEN doc_id % 4 <> 0 THEN upper(s_name) END AS creator, s_acctbal, CASE WHEN doc_id % 5 < 2 THEN 'book/' || doc_id WHEN doc_id % 5 < 4 THEN 'raw/' || doc_id ELSE '' END AS read_path
                   FROM documents LEFT JOIN supplier ON s_suppkey = doc_id % 10 + 1)
        SELECT doc_id, read_path FROM r WHERE read_path <> '' AND contains(lower(coalesce(text, '') || ' ' || coalesce(creator, '') || ' ' || doc_id || '  done ' || coalesce(source, '')), 'the')
          AND NOT coalesce(creator IN (SELECT upper(s_name) FROM supplier WHERE s_acctbal < 2000), false)"""),
    "q_follow_sources": Query(follow_sources, """
        SELECT s_suppkey AS mid, n_name AS sign, s_acctbal < 0 AS pinned FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE contains(lower(s_name || ' ' || s_suppkey || ' ' || n_name || ' '), '1')"""),
}
