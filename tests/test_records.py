"""Checks, overlays, caches, deletions and moments on traced values."""

import json

from pyspark.sql import functions as F

from scriptorium.functions import checks, numbers
from scriptorium.operators import records


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_summary_route(spark):
    for mode, ready, seconds, chars, eligible, against in [
        ("auto", True, 1800, 30000, True, []), ("auto", False, 1801, 30001, False, ["missing_key", "duration_over_route", "content_over_route"]),
        ("always", False, 1801, 1, True, ["missing_key", "duration_over_route"]), ("none", True, 1, 1, False, ["disabled"]),
    ]:
        got = one(spark, checks.summary_route(*map(F.lit, (mode, ready, seconds, chars))))
        assert (got.eligible, got.reasons) == (eligible, against)


def test_artifact_issues(spark):
    good = "# Title\n" + "a" * 600 + "。"
    for text, brief, source, issues in [
        (good, True, 100, []), (good, True, 10_000, ["short"]), ("<think>x</think>\n" + good, False, 0, []), ("首先，我会 " + "b" * 600, False, 0, ["self_talk", "no_heading", "cut"]), ("", False, 0, ["short", "no_heading", "cut"]),
    ]:
        assert one(spark, checks.artifact_issues(*map(F.lit, (text, brief, source)))) == issues


def test_losses_and_lengths(spark):
    assert [one(spark, checks.tolerated(F.lit(n), 5)) for n in (0, 4, 5, 39, 40)] == [0, 0, 1, 1, 2]
    assert [one(spark, checks.too_short(F.lit(n), F.lit(m))) for n, m in ((800, 1), (801, 599), (801, 600))] == [False, True, False]
    cases = [(1000, 719, 0.0, 0.0, ["short"]), (1000, 300, 0.1, 0.5, []), (1000, 300, 0.12, 0.5, ["short"]), (1000, 1451, 0.0, 0.0, ["long"]), (800, 1, 0.0, 0.0, []), (0, 5, 0.0, 0.0, [])]
    for a, b, c, d, issues in cases:
        assert one(spark, checks.cleaning_issues(*map(F.lit, (a, b, c, d)))) == issues


def test_moments(spark):
    for text, ms in [("1700000000", 1_700_000_000_000), ("1700000000123", 1_700_000_000_123), ("2024-01-02T03:04:05Z", 1_704_164_645_000), ("0", None), ("", None), ("2024-02-30", None), (None, None)]:
        assert one(spark, numbers.moment(F.lit(text).cast("string"))) == ms


def test_overlay(spark):
    for new, old, path, title in [(None, '{"path": "o"}', "o", "t"), ('{"path": null}', '{"path": "o"}', None, "t"), ("{}", None, None, "t"), ("broken", '{"path": "o", "title": "x"}', "o", "x"), ('{"title": null}', '{"title": "x"}', None, "x")]:
        a, b = F.lit(new).cast("string"), F.lit(old).cast("string")
        assert (one(spark, records.overlaid(a, b, "path")), one(spark, records.overlaid(a, b, "title", F.lit("t")))) == (path, title)


def test_page_caches(spark):
    now = {"pages": {"2": {"page": 2, "label": "P2 x", "entries": ["c"]}, "10": {"entries": ["d"]}, "3": {"page": 3, "label": "P3", "entries": []}, "4": None}}
    old = {"subtitles": [{"page_segments": [{"label": "P0", "entries": ["z"]}, {"label": "P1", "entries": ["a", "b"]}, {"label": "none", "entries": ["y"]}]}, {"page_segments": [{"label": "P1 again", "entries": ["q"]}]}]}
    rows = spark.createDataFrame([(1, json.dumps(now)), (2, json.dumps(old)), (3, "broken"), (4, None)], "id long, payload string")
    pages = records.cached_pages(rows, "id", "payload")
    got = sorted((r.id, r.page, r.label, r.entries, r.place) for r in records.track(pages, "id").collect())
    assert got == [(1, 2, "P2 x", ["c"], 0), (1, 10, "P10", ["d"], 1), (2, 1, "P1 again", ["q"], 0)]
    assert pages.count() == 4


def test_deletions_and_results(spark):
    rows = spark.createDataFrame([("m/1", "a"), ("m/2", "b"), ("", ""), (None, None), ("m/3", "c")], "path string, source string")
    gone = spark.createDataFrame([("m/1", ""), ("", "c"), ("m/1", ""), (None, None)], "path string, source string")
    got = {r.path: r.removed for r in records.without_packages(rows, gone, F.col("path"), F.col("source")).collect()}
    assert got == {"m/1": True, "m/2": False, "": False, None: False, "m/3": True}
    meta = spark.createDataFrame([(1,), (2,), (2,)], "id long")
    back = spark.createDataFrame([(1, 5), (1, 4), (9, 1)], "id long, n long")
    assert {r.id: (r.state, r.n) for r in records.collected(meta, back, "id", ["n"]).collect()} == {1: ("done", 4), 2: ("missing", None), 9: ("unknown", 1)}
