"""Keyed state with timers and lifetimes: items that come back by themselves, and a cache of two levels.

Both run as ``transformWithState``; the state is in RocksDB and in the checkpoint of the query, so it survives
a restart.  Rows of one key within a micro-batch are sorted in memory; what a micro-batch takes in is bounded by the
options of its source (``maxFilesPerTrigger``, ``maxBytesPerTrigger``).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DataType, IntegerType, LongType, StringType, StructField, StructType

from .retries import DELAYS_MS, SETTLED



def _struct(**kinds: DataType) -> StructType:
    # workers build these too, and have no session to parse a text with
    return StructType([StructField(n, k) for n, k in kinds.items()])


LONG, INT, TEXT = LongType(), IntegerType(), StringType()
LOG = _struct(id=LONG, at=LONG, what=TEXT, retries=INT, due=LONG)
_ITEM = _struct(status=TEXT, retries=INT, due=LONG)


@contextmanager
def rocksdb(spark: SparkSession):
    """State of queries started here is kept in RocksDB; the session's own setting comes back afterwards."""
    key, own = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, own)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Returning(StatefulProcessor):
    """An item is queued, and one outcome at a time can be had of it: a fault makes it wait, and a timer brings it back.

    Of an item that waits or is settled no outcome is taken, as nothing could have claimed it.
    """

    def __init__(self, delays: tuple[int, ...], by_event_time: bool):
        self.delays, self.by_event_time = delays, by_event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.item = handle, handle.getValueState("item", _ITEM)

    def _now(self, at: int, timers) -> int:
        return at if self.by_event_time else timers.getCurrentProcessingTimeInMs()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        status, retries, due = self.item.get() if self.item.exists() else ("queued", 0, 0)
        set_for = due if status == "waiting" else None
        for at, outcome in sorted(((r["at"], r["outcome"]) for r in rows), key=lambda x: (x[0], x[1] is not None, x[1] or "")):
            now = self._now(at, timerValues)
            if status == "waiting" and due <= now:
                yield Row(id=key[0], at=due, what="returned", retries=retries, due=None)
                status = "queued"
            if status != "queued":
                continue
            if outcome in SETTLED:
                status = SETTLED[outcome]
            elif retries == len(self.delays):
                status = "failed"
            else:
                status, due, retries = "waiting", now + self.delays[retries], retries + 1
            yield Row(id=key[0], at=at, what=status, retries=retries, due=due if status == "waiting" else None)
        wanted = due if status == "waiting" else None
        if set_for != wanted:
            if set_for is not None:
                self.handle.deleteTimer(set_for)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        self.item.update((status, retries, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, retries, due = self.item.get()
        if status == "waiting" and due <= expiredTimerInfo.getExpiryTimeInMs():
            self.item.update(("queued", retries, 0))
            yield Row(id=key[0], at=due, what="returned", retries=retries, due=None)

    def close(self) -> None:
        pass


def returning(outcomes: DataFrame, delays: tuple[int, ...] = DELAYS_MS, at: str | None = None, late: str = "0 seconds") -> DataFrame:
    """id, at, what, retries, due: the log of items, from a stream of (id, at in ms, outcome).

    ``what`` is waiting (until ``due``), returned, done, failed or skipped; outcomes are those of ``retries``.
    Timers go by the clock of the machine, or by event time if ``at`` names a timestamp column, which then gets a
    watermark ``late`` behind.  ``retries`` counts the faults so far.
    """
    if at:
        rows = outcomes.select("id", "at", "outcome", F.col(at).alias("seen")).withWatermark("seen", late)
        return rows.groupBy("id").transformWithState(Returning(delays, True), LOG, "Append", "EventTime")
    return outcomes.select("id", "at", "outcome").groupBy("id").transformWithState(Returning(delays, False), LOG, "Append", "ProcessingTime")


PAGE_FIELDS = ("version", "provider", "model", "language", "label", "prompt", "signature")
CHUNK_FIELDS = ("version", "provider", "model", "language", "offset", "chunk", "prompt")
FOUND = _struct(request=LONG, page=TEXT, chunk=TEXT)
_FOUND = StructType([StructField(f.name, ArrayType(f.dataType)) for f in FOUND])
_AT_ONCE = 1000


def _asked(row: Row) -> tuple:
    """Place, page and chunk of a packed request; one without a number comes last."""
    request, page, chunk = row["asked"].split("|")
    return not request, int(request or 0), page, chunk


class Cache(StatefulProcessor):
    """The page that was kept last, and the chunks kept so far, of one page number of one source.

    A call of the state is a round trip to the JVM: there are five at most a micro-batch, however many rows it has of
    the key, and answers come out some at a time.  The live chunks of a key that had some are read whole.  Lives are counted from the start of a micro-batch: none ends within it.
    """

    def __init__(self, page_ms: int | None, chunk_ms: int | None):
        self.page_ms, self.chunk_ms = page_ms, chunk_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        text = _struct(value=TEXT)
        self.page = handle.getValueState("page", text, self.page_ms)
        self.chunks = handle.getListState("chunks", text, self.chunk_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = self.page.get()[0] if self.page.exists() else None
        # pages without an end outlive their chunks
        known = set() if kept is None and not self.page_ms else {c for (c,) in self.chunks.get()}
        changed, new, found = False, [], []
        for unnumbered, request, page, chunk in sorted(map(_asked, rows)):
            answer = "hit" if kept == page else "miss" if kept is None else "stale"
            found.append((None if unnumbered else request, answer, None if answer == "hit" else "hit" if chunk in known else "miss"))
            if answer != "hit":
                kept, changed = page, True
                if chunk not in known:
                    known.add(chunk)
                    new.append((chunk,))
            if len(found) == _AT_ONCE:
                yield Row(**dict(zip(FOUND.names, map(list, zip(*found, strict=True)), strict=True)))
                found = []
        if changed:
            self.page.update((kept,))
        if new:
            self.chunks.appendList(new)
        if found:
            yield Row(**dict(zip(FOUND.names, map(list, zip(*found, strict=True)), strict=True)))

    def close(self) -> None:
        pass


def cached(requests: DataFrame, keys: list[str], page_ms: int | None = None, chunk_ms: int | None = None) -> DataFrame:
    """request, page, chunk: what a cache of two levels answers to each request of a stream, in the order of ``request``.

    A page is a hit if all of ``PAGE_FIELDS`` equal those of the page kept last for ``keys``, stale if one differs, a miss
    if none was kept; of a page that is no hit the chunk is looked up by all of ``CHUNK_FIELDS``.  What was not there is
    kept.  ``page_ms`` and ``chunk_ms`` end the life of an entry that long after it was kept, by the clock of the machine.
    Null fields equal each other.
    """
    packed = lambda names: F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)
    asked = F.concat_ws("|", F.coalesce(F.col("request").cast("string"), F.lit("")), packed(PAGE_FIELDS), packed(CHUNK_FIELDS))
    mode = "ProcessingTime" if page_ms or chunk_ms else "None"
    found = requests.select(*keys, asked.alias("asked")).groupBy(*keys).transformWithState(Cache(page_ms, chunk_ms), _FOUND, "Append", mode)
    return found.select(F.inline(F.arrays_zip(*FOUND.names)))


def within(activity: DataFrame, pauses: DataFrame, key: str, at: str, start: str, until: str, longest: str, late: str) -> DataFrame:
    """Activity with the pauses it falls in, null where none: an outer join of two streams over an interval.

    A pause holds from its start to before its end, ``longest`` at most, which bounds the state; a row without
    a pause comes out once the watermarks, ``late`` behind, have passed all pauses that could hold it.
    """
    a, p = activity.withWatermark(at, late), pauses.withWatermark(start, late).withColumnRenamed(key, f"paused_{key}")
    held = (F.col(key) == F.col(f"paused_{key}")) & (F.col(at) >= F.col(start)) & (F.col(at) < F.col(until)) & (F.col(at) < F.col(start) + F.expr(f"INTERVAL {longest}"))
    return a.join(p, held, "left_outer").drop(f"paused_{key}")
