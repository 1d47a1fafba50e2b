"""Sentences and subtitle tracks on small inputs."""

from pyspark.sql import functions as F

from scriptorium.functions import sentences as S
from scriptorium.operators import tracks


def test_sentences(spark):
    def of(f, *texts):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        return [r.v for r in rows.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]

    assert of(S.brief_points, "a;B；b。 c，d", "1,2 x.y . z", None, "", "p\np\nq\nr\ns\nt") == [["a", "B", "c", "d"], ["1,2 x.y", "z"], [], [], ["p", "q", "r", "s"]]
    assert of(lambda t: S.compact_sentences(t, 4), "a。b。cc! dddddd?e\n\nf", None, " ") == [["a。 b。", "cc!", "dddddd?", "e f"], [], []]
    # the limit counts before repeats go
    assert of(lambda t: S.keyword_sentences(t, ("KEY",), 2), "no。a key。A KEY！b key", None, "") == [["a key"], [], []]
    assert of(lambda t: S.keyword_sentences(t, ("k",), 2, 5), "kkkk   kkkk") == [["kkkk…"]]


KIND = "track string, at int, page int, label string, `from` double, `to` double, text string"


def test_page_groups(spark):
    rows = [("t", 1, 2, "b", 5.0, 6.0, "x"), ("t", 2, None, "", None, None, " y "), ("t", 3, 2, "b", 7.0, 8.0, "z"), ("t", 4, 3, "c", 0.0, 0.0, " "), ("u", 1, 1, "a", 0.0, 1.0, None)]
    got = tracks.page_groups(spark.createDataFrame(rows, KIND), ["track"], "at").orderBy("place").collect()
    assert [(r.track, r.page, r.label, [e.text for e in r.entries]) for r in got] == [("t", 2, "b", ["x", "z"]), ("t", 1, "P1", ["y"])]
    assert got[1].entries[0]["from"] == 0.0


def test_merged_tracks(spark):
    kind = "track string, at int, page int, label string, paged boolean"
    base = spark.createDataFrame([("t", 1, None, "", False), ("t", 2, 3, "x", True), ("u", 1, None, "", False)], kind)
    more = spark.createDataFrame([("t", 1, None, "P2 y", True), ("t", 2, 3, "z", True), ("u", 1, None, "", False)], kind)
    got = tracks.merged(base, more, ["track"], "at").orderBy("track", "place").collect()
    assert [(r.track, r.label) for r in got] == [("t", "P2 y"), ("t", "x"), ("t", "z"), ("u", ""), ("u", "")]


def test_chunk_times(spark):
    rows = spark.createDataFrame([("g", 1, 1, "a", 3.0, 4.0, "x"), ("g", 2, 1, "b", None, 9.0, "x")], KIND).withColumnRenamed("track", "g")
    chunks = spark.createDataFrame([("g", 1, ["a ", ""]), ("g", 2, []), ("g", 3, ["c"]), ("h", 1, None)], "g string, chunk int, labels array<string>")
    got = {(r.g, r.chunk): (r["from"], r["to"]) for r in tracks.chunk_times(chunks, rows, "g", "chunk", "labels").collect()}
    assert got == {("g", 1): (3.0, 4.0), ("g", 2): (0.0, 9.0), ("g", 3): (None, None), ("h", 1): (None, None)}
