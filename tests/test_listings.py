"""Listings on small tables."""

from pyspark.sql import functions as F

from scriptorium.functions import checks as C
from scriptorium.operators import listings as L
from scriptorium.plans import inventory

COLUMNS = "title string, creator string, source_id string, source_url string, stage string, text_source string, read_path string, pinned_name string"
ROWS = [("Alpha", " Ann  LEE", "1", None, "x", "s", "p1", "c"), ("beta", "Bob", "2", "http://A", "x", "s", "p2", None), ("none", None, "3", None, "x", "s", "p3", None), ("gone", "Bob", "4", None, "x", "s", "", None), ("twice", "ann lee", "5", None, None, None, "p5", None)]


def titles(df):
    return sorted(r.title for r in df.collect())


def test_materials(spark):
    rows = spark.createDataFrame(ROWS, COLUMNS)
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert titles(L.materials(rows)) == ["Alpha", "beta", "none", "twice"]
    assert titles(L.materials(rows, " A ")) == ["Alpha", "beta", "twice"]
    assert titles(L.materials(rows, creator="ANN　lee ")) == ["Alpha", "twice"]
    assert titles(L.materials(rows, pinned=names("Ann Lee", "ann  lee", " ", None))) == ["beta", "none"]
    assert titles(L.materials(rows, pinned=names())) == ["Alpha", "beta", "none", "twice"]
    assert titles(L.materials(rows.limit(0), "a", pinned=names("x"))) == []


def test_read_path(spark):
    row = spark.range(1).select(L.read_path((F.lit(False), F.lit("a")), (F.lit(True), F.lit("")), (F.lit(None).cast("boolean"), F.lit("b")), (F.lit(True), F.lit("c"))).alias("p"), L.read_path((F.lit(True), F.lit(None).cast("string"))).alias("q")).first()
    assert tuple(row) == ("c", "")


def test_sources_keep_their_order(spark):
    items = spark.createDataFrame([(i, f"n{i}", "Sign" if i % 2 else None, None, i) for i in range(6)], "mid int, name string, sign string, official_title string, position int")
    pinned = spark.createDataFrame([(4,), (1,), (4,), (None,)], "mid int")
    got = lambda *a: [r.mid for r in L.sources(items, pinned, *a).collect()]
    assert got() == [1, 4, 0, 2, 3, 5]
    assert got("sIGN") == [1, 3, 5]
    assert got("", True) == [1, 4]


def test_repair_notes(spark):
    names = "t array<string>, m array<string>, y array<string>, r double, s array<string>, l double"
    rows = spark.createDataFrame([(None, [], None, None, None, None), ([str(i) for i in range(20)], None, [], 0.72, list("abcde"), None), ([], ["1:00"], ["1999年"], 0.7, [], None), (None, None, None, 0.7, None, 0.24), (None, None, None, 1.5, None, None)], names)
    got = [r[0] for r in rows.select(C.repair_notes(*map(F.col, "tmyrsl"))).collect()]
    n = C.NOTES
    assert got == [[], [n[0] + ", ".join(map(str, range(12))), n[5] + "a；b；c；d"], [n[1] + "1:00", n[2] + "1999年", n[3]], [], [n[4]]]


def test_replies_fetched_twice(spark, tmp_path):
    """Each reply of a thread counts once, without a number too; the plan holds no join and no table of replies."""
    rows = [(1, 1, "A"), (1, 1, "R"), (1, 2, "A"), (1, 2, "A"), (1, 3, None), (1, None, "R"), (1, None, "A"), (2, 1, "A"), (3, 1, None), (None, 1, "N")]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = inventory.merged_replies(spark, str(tmp_path))
    assert {r.thread: (r.kept, r.added) for r in out.collect()} == {1: (2, 1), 2: (0, 1), None: (1, 0)}
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "HashAggregate(keys=[thread#" not in "\n".join(x for x in plan.splitlines() if ", reply#" in x.split("functions=")[0])
