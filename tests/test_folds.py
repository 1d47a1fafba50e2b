"""Folds in bounded memory: state over batch edges, hot packages, whole chunks, sources of all shapes, transcripts."""

import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import segments as G
from scriptorium.operators import chunking, folds, units


def test_hot_package_over_batch_edges(spark):
    """A package of a third of all rows, in batches of a few hundred."""
    rng = random.Random(3)
    sizes = [rng.randrange(1, 40) for _ in range(60_000)]
    rows = [("hot", i, "a" if i // 50 % 2 else "b", n) for i, n in enumerate(sizes)] + [(f"p{i}", 0, "a", 3) for i in range(2000)] + [(None, i, None, 5) for i in range(3)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 300)
    df = spark.createDataFrame(rows, "p string, i int, label string, n int").repartition(7)
    got = {(r.p, r.chunk): (r.first, r.last) for r in chunking.chunk_ranges(df, ["p"], "i", "label", "n", 100, 120, 2).collect()}
    expected, buffer, held, fresh, k = {}, [], 0, False, 0

    def close(keep):
        nonlocal buffer, held, fresh, k
        k += 1
        expected["hot", k] = (buffer[0][1] + 1, buffer[-1][1] + 1)
        buffer = buffer[-2:] if keep else []
        held, fresh = sum(b[3] for b in buffer), False

    for r in rows[:60_000]:
        if buffer and buffer[-1][2] != r[2]:
            close(False)
        if buffer and held + r[3] > 100:
            close(True)
        buffer.append(r)
        held, fresh = held + r[3], True
        if held > 120:
            close(True)
    if fresh:
        close(False)
    expected |= {(f"p{i}", 1): (1, 1) for i in range(2000)} | {(None, 1): (1, 3)}
    assert got == expected


def test_whole_chunks(spark):
    rows = [("p", 0, "a", " x\n", 5, 0.0, 4.0), ("p", 1, "a", "y", 5, None, None), ("p", 2, "a", "z", 5, 8.0, 9.0), ("p", 3, "b", None, 1, 9.0, None), ("q", 0, None, "t", 1, None, None)]
    df = spark.createDataFrame(rows, "p string, i int, label string, t string, n int, f double, e double")
    got = sorted(tuple(r) for r in chunking.build_chunks(df, ["p"], ["i"], "label", "t", "n", "f", "e", 10, 12, 1).collect())
    assert [g[:7] for g in got] == [
        ("p", 1, "## a\n\n x\n\ny", ["a"], 0.0, 4.0, 2), ("p", 2, "## a\n\ny\nz", ["a"], 8.0, 9.0, 2), ("p", 3, "## b", ["b"], 9.0, None, 1), ("q", 1, "## \n\nt", [None], None, None, 1),
    ]
    assert all(g[7] >= 1 for g in got) and chunking.build_chunks(df.limit(0), ["p"], ["i"], "label", "t", "n", "f", "e").isEmpty()


def test_merge_groups_name_role_and_terms(spark):
    parts = [("x", ["t", "u"], False), ("x", ["u", "v"], False), ("x", None, False), ("y", ["a"], True), ("y", ["a"], False), ("y", ["b"], False)]
    rows = spark.createDataFrame([("p", i, *r) for i, r in enumerate(parts)], "p string, i int, role string, terms array<string>, noisy boolean")
    got = sorted((r.merge, r.first, r.last, r.role, r.terms) for r in chunking.merge_groups(rows, ["p"], "i", "role", "terms", "noisy").collect())
    assert got == [(1, 1, 3, "x", ["t", "u", "v"]), (2, 5, 6, "y", ["a", "b"])]


def test_sources_of_all_shapes(spark):
    entry = lambda t, f=None: {"content": t, "from": f, "to": f}
    sources = [
        (1, json.dumps("一句。二句。")), (2, json.dumps({"text": "abc"})), (3, json.dumps([{"lang": "zh", "entries": [entry("a", 1.5), entry(" "), entry("b", 3)]}])),
        (4, json.dumps({"subtitles": [{"lang": "zh", "entries": [entry("no")], "page_segments": [{"label": " P1 ", "entries": [entry("yes", 0)]}, {"entries": [entry("too")]}]}, {"entries": [entry("third")]}], "text": "no"})),
        (5, "7"), (6, None), (7, "{broken"), (8, json.dumps({"subtitles": []})), (9, json.dumps({"other": 1})),
    ]
    df = spark.createDataFrame(sources, "k int, s string")
    got = sorted((r.k, r.track, r.segment, r["pack"], r.label, r.text, r.start, r.end) for r in units.source_units(df, "k", "s", 2).collect())
    assert got == [
        (1, 0, 0, 1, "原始文本", "一句。", None, None), (1, 0, 0, 2, "原始文本", "二句。", None, None), (2, 0, 0, 1, "原始文本", "abc", None, None), (3, 0, 0, 1, "zh", "a b", 1.5, 3.0),
        (4, 0, 0, 1, "P1", "yes", 0.0, 0.0), (4, 0, 1, 1, "未命名分段", "too", None, None), (4, 1, 0, 1, "字幕内容", "third", None, None),
    ]
    assert sorted(r.k for r in units.unread(df, "k", "s").collect()) == [5, 6, 7, 9]


def test_sources_are_not_parsed_in_filters(spark, tmp_path):
    """A filter on what is read would go down to the scan, and parse each source once more."""
    spark.createDataFrame([(1, json.dumps("一。")), (2, json.dumps([None, {"lang": "b", "entries": [{"content": "x"}]}]))], "k int, s string").write.parquet(f"{tmp_path}/in")
    out = units.source_units(spark.read.parquet(f"{tmp_path}/in"), "k", "s", 2)
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [x for x in plan if "Filter" in x and ("from_json" in x or "get_json" in x)]
    assert sorted((r.k, r.track, r.text) for r in out.collect()) == [(1, 0, "一。"), (2, 1, "x")]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab。，, \n;!", max_size=700), st.integers(40, 60), st.integers(60, 80))
def test_segments_keep_the_text_and_their_limits(text, target, most):
    parts = G.split_transcript(text, target, most)
    assert "".join("".join(parts).split()) == "".join(text.split()) and all(parts)
    rough = G.rough_parts(" ".join(text.split()), target, most)
    assert all(len(p) <= max(most, max(map(len, rough), default=0) + target) for p in parts)


def test_segments_of_texts_without_marks(spark):
    rows = spark.createDataFrame([("字" * 250,), (None,), ("  ",), ("a" * 95 + "，" + "b" * 10,), ("短！长" + "x" * 200 + "。",)], "t string")
    got = [r.s for r in rows.select(G.transcript_segments(F.col("t")).alias("s")).collect()]
    assert [list(map(len, s)) for s in got] == [[120, 120, 10], [], [], [96, 10], [2, 202]]
    timed = rows.limit(1).select("t", G.transcript_segments(F.col("t")).alias("s")).select(G.timed_entries(F.col("s"), F.length("t"), F.lit(5.0), F.lit(0.0)).alias("e")).first().e
    assert (timed[0]["from"], round(timed[-1].to, 6)) == (5.0, round(5 + 250 / 7, 6))


def test_running_sees_each_group_once(spark):
    rows = spark.createDataFrame([(g, i, 1) for g in ("a", "b", None) for i in range(50)], "g string, i int, x long")
    out = folds.running(rows, ["g"], ["i"], "x", lambda: 0, lambda s, x: (s + x, s + x), "n").collect()
    assert all(r.n == r.i + 1 for r in out) and len(out) == 150
