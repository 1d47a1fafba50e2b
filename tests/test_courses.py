"""Chapter groups, cleaning chunks, reuse, changed rows and retries, on small inputs."""

import random

import pytest

from scriptorium.operators import chunking, packing, relational
from scriptorium.streaming import retries, tables


def grouped(lessons, most=24):
    """Root chapters of one course as ranges, by the plain rule."""
    n = [max(1, x or 1) for x in lessons]
    if len(n) <= most:
        return [(i, i) for i in range(1, len(n) + 1)]
    out, lo, held = [], 1, 0
    for i, x in enumerate(n, 1):
        waiting = i - lo
        if x > 2 and waiting > 1 and held + x > 8:
            out += [(lo, i - 1), (i, i)]
        elif x > 2 or (waiting and held + x >= 8):
            out.append((lo, i))
        else:
            held += x
            continue
        lo, held = i + 1, 0
    if lo <= len(n):
        out.append((lo, len(n)))
    if len(out) <= most:
        return out
    span = max(2, -(-len(out) // most))
    return [(out[k][0], out[min(k + span, len(out)) - 1][1]) for k in range(0, len(out), span)]


def test_chapter_groups(spark):
    rng = random.Random(5)
    courses = [[rng.choice([0, 1, 1, 2, 3, 7, 9, None]) for _ in range(rng.choice([1, 24, 25, 60, 200]))] for _ in range(30)]
    rows = [(c, i, x) for c, lessons in enumerate(courses) for i, x in enumerate(lessons)]
    got = chunking.chapter_groups(spark.createDataFrame(rows, "course int, at int, n int"), ["course"], "at", "n").collect()
    found = {}
    for r in sorted(got):
        found.setdefault(r.course, []).append((r.first, r.last))
    assert found == {c: grouped(lessons) for c, lessons in enumerate(courses)}


def test_cleaning_chunks(spark):
    rows = [(1, 1, " ab\n", "P1", 0.0, 5.0), (1, 2, "cd", "P1", None, 9.0), (1, 3, "\u3000", "P2", 9.0, 10.0), (1, 4, "ef", "P2", 3600.0, None), (1, 5, "ghi", "", None, None), (1, 6, "j", "P2", None, None)]
    units = spark.createDataFrame(rows, "g int, at int, text string, label string, f double, t double")
    got = packing.cleaning_chunks(units, "g", "at", "text", "label", "f", "t", 6, context=4).orderBy("chunk").collect()
    first = "## P1\n[00:00-00:05] ab\n[?-00:09] cd\n\n## P2\n[01:00:00-?] ef"
    assert [r.text for r in got] == [first, "ghi\n\n## P2\nj"]
    assert [(r.labels, r.start, r.end, r.previous_tail, r.next_head) for r in got] == [(["P1", "P2"], 0.0, 9.0, "", "ghi\n"), (["P2"], None, None, "] ef", "")]
    assert packing.cleaning_chunks(units.limit(0), "g", "at", "text", "label", "f", "t").isEmpty()


def test_reuse_wants_every_artifact(spark):
    want = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "x"), (3, "a", None)], "run int, name string, key string")
    held = spark.createDataFrame([(1, "a", "x", True), (1, "b", "y", True), (1, "b", "y", False), (2, "a", "z", True), (3, "a", None, True)], "run int, name string, key string, ok boolean")
    assert {r.run: r.reusable for r in relational.reusable(want, held, "run", "name", "key", "ok").collect()} == {1: True, 2: False, 3: False}


def test_only_changed_rows_are_written(spark):
    kind = "id int, a string, b double"
    old = spark.createDataFrame([(1, "x", None), (2, "y", 1.0), (3, None, 2.0)], kind)
    new = spark.createDataFrame([(1, "x", None), (2, "y", 2.0), (3, "z", 2.0), (4, None, None)], kind)
    assert sorted(r.id for r in relational.changed_rows(new, old, "id").collect()) == [2, 3, 4]
    assert relational.changed_rows(old, old, "id").isEmpty()


@pytest.mark.parametrize("files", [1, 100])
def test_retries_over_batches(spark, tmp_path, files):
    """The same states whether the outcomes come in one batch or one by one."""
    runs = {1: ["fault", "ok", "fault"], 2: ["fault"] * 5 + ["ok"], 3: ["fault", "config"], 4: [None, "fault", "hopeless"], 5: ["fault", "fault"], 6: ["ok"]}
    for at in range(6):
        rows = [(k, at, v[at]) for k, v in runs.items() if at < len(v)]
        spark.createDataFrame(rows, "id long, at long, outcome string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = tables.arrived(spark, str(tmp_path / "in"), "id long, at long, outcome string", files=files)
    tables.run(retries.advance(stream), str(tmp_path / "state"), tables.to_versions(str(tmp_path / "out")), "update")
    got = {r.id: (r.status, r.retries, r.wait_ms) for r in tables.newest(spark, str(tmp_path / "out"), ["id"]).collect()}
    m = 60_000
    assert got == {1: ("done", 1, 0), 2: ("failed", 3, 0), 3: ("failed", 1, 5 * m), 4: ("skipped", 2, 0), 5: ("queued", 2, 30 * m), 6: ("done", 0, 0)}
