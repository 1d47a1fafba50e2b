"""Timers, lifetimes and restarts of streams; paged backfill and run states against folds in order."""

import itertools
import random
import time
from collections import Counter
from types import SimpleNamespace

from pyspark.sql import Row
from pyspark.sql import functions as F

from scriptorium.operators import runs
from scriptorium.streaming import tables, timers

BASE = 1_000_000
OUT = "id long, at long, outcome string"


def test_items_return_by_the_clock(spark, tmp_path):
    """Nothing arrives after the fault: the timer alone brings the item back."""
    spark.createDataFrame([(1, 1, "fault"), (2, 1, "ok"), (2, 2, "fault"), (3, 1, "config"), (3, 2, "ok")], OUT).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(OUT).parquet(f"{tmp_path}/in")
    with timers.rocksdb(spark):
        query = timers.returning(stream, (1500,)).writeStream.foreachBatch(tables.to_versions(f"{tmp_path}/log")).option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="300 milliseconds").start()
        rows, began = [], time.time()
        while time.time() - began < 90 and not any(r.what == "returned" for r in rows):
            time.sleep(1)
            rows = spark.read.schema(timers.LOG).parquet(f"{tmp_path}/log/*").collect() if list(tmp_path.glob("log/*/*.parquet")) else []
        query.stop()
    assert Counter((r.id, r.what, r.retries) for r in rows) == Counter([(1, "waiting", 1), (1, "returned", 1), (2, "done", 0), (3, "failed", 0)])
    wait = {r.what: r for r in rows if r.id == 1}
    assert wait["returned"]["at"] == wait["waiting"].due


def test_items_by_event_time_over_restarts(spark, tmp_path):
    """Outcomes that nothing could have claimed are not taken; state and timers outlive the query."""
    batches = [
        [(1, 0, "fault"), (1, 50, "ok"), (1, 100, "fault"), (2, 0, None)], [(1, 250, "fault"), (1, 300, "fault"), (2, 90, "ok")], [(1, 10_000, "x"), (2, 20_000, "ok")], [(9, 900_000, "ok")],
    ]
    for rows in batches:
        with timers.rocksdb(spark):
            df = spark.createDataFrame([(i, BASE + at, o) for i, at, o in rows], OUT).withColumn("seen", F.timestamp_millis("at"))
            df.write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
            tables.run(timers.returning(stream, (100, 200, 400), at="seen"), f"{tmp_path}/state", tables.to_versions(f"{tmp_path}/log"))
    got = sorted(((r.id, r["at"] - BASE, r.what, r.retries, r.due and r.due - BASE) for r in spark.read.parquet(f"{tmp_path}/log").collect() if r.id != 9), key=str)
    assert got == sorted([
        (1, 0, "waiting", 1, 100), (1, 100, "returned", 1, None), (1, 100, "waiting", 2, 300), (1, 300, "returned", 2, None), (1, 300, "waiting", 3, 700), (1, 700, "returned", 3, None),
        (1, 10_000, "failed", 3, None), (2, 0, "waiting", 1, 100), (2, 100, "returned", 1, None), (2, 20_000, "done", 1, None),
    ], key=str)


def request(n, page=1, **changed):
    base = dict.fromkeys((*timers.PAGE_FIELDS, *timers.CHUNK_FIELDS), "x") | {"language": None} | changed
    return {"page": page, "request": n, **base}


def test_cache_of_two_levels(spark, tmp_path):
    rows = [request(1), request(2), request(3, label="y"), request(4), request(5, prompt="p"), request(6, offset="7"), request(7, page=2), request(8, language=""), *(request(10 + i, **{f: "new"}) for i, f in enumerate(timers.PAGE_FIELDS))]
    schema = "page long, request long, " + ", ".join(f"{c} string" for c in dict.fromkeys((*timers.PAGE_FIELDS, *timers.CHUNK_FIELDS)))
    names = [c.split()[0] for c in schema.split(", ")]
    for part in (rows[:4], rows[4:]):
        df = spark.createDataFrame([tuple(r[n] for n in names) for r in part], schema)
        df.write.mode("append").parquet(f"{tmp_path}/in")
        with timers.rocksdb(spark):
            tables.run(timers.cached(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), ["page"]), f"{tmp_path}/state", tables.to_versions(f"{tmp_path}/log"))
    got = {r.request: (r.page, r.chunk) for r in spark.read.parquet(f"{tmp_path}/log").collect()}
    assert {k: got[k] for k in range(1, 9)} == {1: ("miss", "miss"), 2: ("hit", None), 3: ("stale", "hit"), 4: ("stale", "hit"), 5: ("stale", "miss"), 6: ("stale", "miss"), 7: ("miss", "miss"), 8: ("stale", "miss")}
    assert all(got[10 + i][0] == "stale" for i in range(7)), "any of the seven fields makes a page stale"


def test_cache_entries_end(spark, tmp_path):
    for n in (1, 2):
        schema = "page long, request long, " + ", ".join(f"{c} string" for c in dict.fromkeys((*timers.PAGE_FIELDS, *timers.CHUNK_FIELDS)))
        df = spark.createDataFrame([tuple(request(n)[c.split()[0]] for c in schema.split(", "))], schema)
        df.write.mode("append").parquet(f"{tmp_path}/in")
        with timers.rocksdb(spark):
            query = timers.cached(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), ["page"], page_ms=1000).writeStream.foreachBatch(tables.to_versions(f"{tmp_path}/log")).option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="200 milliseconds").start()
            began = time.time()
            while time.time() - began < 60 and (not list(tmp_path.glob("log/*/*.parquet")) or spark.read.schema(timers.FOUND).parquet(f"{tmp_path}/log/*").count() < n):
                time.sleep(0.5)
            query.stop()
        time.sleep(1.5)
    got = {r.request: (r.page, r.chunk) for r in spark.read.parquet(f"{tmp_path}/log").collect()}
    assert got == {1: ("miss", "miss"), 2: ("miss", "hit")}, "the page ended, its chunk did not"


class Kept:
    """A state of one key that counts its calls."""

    def __init__(self):
        self.calls, self.rows = 0, []

    def exists(self):
        self.calls += 1
        return bool(self.rows)

    def get(self):
        self.calls += 1
        return self.rows if len(self.rows) != 1 else self.rows[0]

    def update(self, row):
        self.calls += 1
        self.rows = [row]

    def appendList(self, rows):  # noqa: N802
        self.calls += 1
        self.rows = self.rows + rows


def test_cache_calls_its_state_a_few_times_a_batch():
    page, chunks = Kept(), Kept()
    cache = timers.Cache(None, None)
    cache.init(SimpleNamespace(getValueState=lambda *_: page, getListState=lambda *_: chunks, getMapState=lambda *_: chunks))
    for base in (0, 5000):
        asked = [Row(asked=f"{base + i}|p{i % 3}|c{i % 7}") for i in reversed(range(3000))]
        got = [x for out in cache.handleInputRows(("k",), iter(asked), None) for x in zip(out["request"], out["page"], out["chunk"], strict=True)]
        assert [x[0] for x in got] == [base + i for i in range(3000)]
        new = 7 if base == 0 else 0
        assert [x[2] for x in got] == ["miss"] * new + ["hit"] * (3000 - new)
    assert page.calls + chunks.calls <= 10, "two micro-batches of 3000 rows each"


def test_cache_of_a_missing_page_number_and_request(spark, tmp_path):
    schema = "page long, request long, " + ", ".join(f"{c} string" for c in dict.fromkeys((*timers.PAGE_FIELDS, *timers.CHUNK_FIELDS)))
    rows = [request(n, page=None, label=f"l{n // 2}") for n in range(1, 1300)] + [request(None, page=None, label="l0")]
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    df.write.parquet(f"{tmp_path}/in")
    with timers.rocksdb(spark):
        tables.run(timers.cached(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), ["page"]), f"{tmp_path}/state", tables.to_versions(f"{tmp_path}/log"))
    got = {r.request: (r.page, r.chunk) for r in spark.read.parquet(f"{tmp_path}/log").collect()}
    wanted = {n: ("hit", None) if n % 2 else ("stale", "hit") for n in range(2, 1300)}
    assert got == wanted | {1: ("miss", "miss"), None: ("stale", "hit")}


def test_paged_backfill_resumes(spark):
    listed = spark.createDataFrame([("a", i) for i in range(7)] + [("b", i) for i in range(6)] + [("c", i) for i in range(6)], "s string, i int")
    cursors = spark.createDataFrame([("a", 0, True, 7), ("b", 0, True, 6), ("c", 0, True, None), ("d", 0, True, None), ("e", 4, False, 9)], "s string, page long, more boolean, total long")
    seen = []
    for _ in range(5):
        rows, after = runs.next_pages(cursors, listed, "s", ["i"], 3)
        seen += [(r.s, r.i) for r in rows.collect()]
        cursors = spark.createDataFrame(after.collect(), after.schema)
    assert len(seen) == len(set(seen)) == 19
    assert {r.s: (r.page, r.more) for r in cursors.collect()} == {"a": (3, False), "b": (2, False), "c": (3, False), "d": (1, False), "e": (4, False)}


def in_order(patches):
    stage, completed, steps = None, [], {}
    for _, _, s, step, status, add, remove in sorted(patches, key=lambda p: p[1]):
        stage = s if s is not None else stage
        if step is not None:
            steps.pop(step, None)
            steps[step] = status
        completed = [c for c in completed if c != remove]
        if add is not None and add not in completed:
            completed.append(add)
    return stage, completed, [k if v is None else f"{k}={v}" for k, v in steps.items()]


def test_run_states_whatever_the_partitions(spark):
    rng = random.Random(4)
    some = lambda *xs: rng.choice([None, *xs])
    patches = [(rng.randrange(12), i, some("x", "y"), some("s1", "s2", "s3"), some("ok"), some("a", "b", "c"), some("a", "b")) for i in range(400)] + [(99, 1000, None, None, None, None, "a")]
    df = spark.createDataFrame(patches, "k int, at int, stage string, step string, step_status string, add string, remove string")
    expected = {k: in_order(list(g)) for k, g in itertools.groupby(sorted(patches, key=lambda p: p[0]), key=lambda p: p[0])}
    for n in (1, 5):
        got = {r.k: (r.stage, r.completed, r.steps) for r in runs.run_states(df.repartition(n, F.rand(n)), "k", "at").collect()}
        assert got == expected
