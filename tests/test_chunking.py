"""Folds over packages, traced by hand."""

from scriptorium.operators import chunking


def ranges(df, name):
    return sorted((r[name], r["first"], r["last"]) for r in df.collect())


def units(spark, rows):
    return spark.createDataFrame([("p", i, *r) for i, r in enumerate(rows)], "p string, i int, label string, n int")


def test_chunks_keep_units(spark):
    rows = units(spark, [("a", 4), ("a", 4), ("a", 4), ("a", 1)])
    assert ranges(chunking.chunk_ranges(rows, ["p"], "i", "label", "n", 10, 12, 1), "chunk") == [(1, 1, 2), (2, 2, 4)]


def test_chunk_of_kept_units_only(spark):
    # the second unit is too large: the chunk closes after it and keeps it; the next label makes a chunk of it alone
    rows = [("a", 4), ("a", 30), ("b", 2)]
    assert ranges(chunking.chunk_ranges(units(spark, rows), ["p"], "i", "label", "n", 40, 32, 1), "chunk") == [(1, 1, 2), (2, 2, 2), (3, 3, 3)]
    # at the end kept units make none
    assert ranges(chunking.chunk_ranges(units(spark, rows[:2]), ["p"], "i", "label", "n", 40, 32, 1), "chunk") == [(1, 1, 2)]


def test_short_last_block_joins(spark):
    rows = units(spark, [("", 12), ("", 12), ("", 3)])
    assert ranges(chunking.block_ranges(rows, ["p"], "i", "n", 10, 20, 5), "block") == [(1, 1, 1), (2, 2, 3)]
    assert ranges(chunking.block_ranges(rows.limit(1), ["p"], "i", "n", 10, 20, 50), "block") == [(1, 1, 1)]


def test_merges(spark):
    parts = [("x", ["t"], False), ("x", ["u"], False), ("x", ["v"], False), ("x", ["w"], False), ("x", None, True), ("y", [], False), ("y", [], False), ("z", ["t"], False)]
    rows = spark.createDataFrame([("p", i, *r) for i, r in enumerate(parts)], "p string, i int, role string, terms array<string>, noisy boolean")
    assert ranges(chunking.merge_ranges(rows, ["p"], "i", "role", "terms", "noisy"), "merge") == [(1, 1, 3), (2, 6, 7)]
