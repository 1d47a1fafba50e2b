"""Exact top-k by inner product through an index of pivot distances.

The index keys each vector by its nearest pivot and the distance to it, sorts by range, and packs what
lies between two distances, an annulus, into blocks with their least and largest distance and their
largest squared length.  For a query at distance d from the pivot, the triangle inequality gives
|q - v| >= max(d - largest, least - d), and as 2 <q, v> = |q|^2 + |v|^2 - |q - v|^2 this bounds the
scores of the whole annulus.  Each query first searches the part of the index with the largest bound,
outwards from the annulus nearest to it; its k-th score then decides which other parts it is sent to,
and within a part a query stops once no annulus left has a bound as high.  Bounds are floats with slack
and only ever decide to skip; scores and ties are exact.

Queries travel in blocks to the parts that may hold an answer; a part is what one task sorted of one
pivot, so no part grows with a hot vector, whose copies spread by id over tasks.  A part sends back at most k rows a query.
The driver holds the pivots (a parameter) and four numbers a part, of which there are as many as pivots
and partitions of the shuffle together.

Cases: vectors that are null or hold null or non-finite components, and rows without an id, take no part; vectors of
several lengths compare by what both have (an empty vector scores 0); rows that repeat are candidates
each; all rows with a query's id count as its own row; a query row that repeats gives its list again;
ties go to the smaller id; with fewer candidates than k all are listed; an empty table gives no rows.
A score beyond a long counts as the nearest long.  Of the columns only id and vector are read.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, rows_of, stage
from .vectors import BLOCK, as_float, as_long, joined, packed, products, scaled, squares, unpacked, whole

ANNULUS, LARGEST = 1024, 1 << 20  # vectors, and components at most, in an annulus
QUERIES = 128  # queries in a block
OPEN = 32  # blocks of queries whose results a task keeps in memory
PIVOTS = 32
INDEX = f"part int, pivot int, least double, most double, length double, n int, ids binary, rows binary, {BLOCK}"
WANTED = f"part int, pivot int, n int, ids binary, rows binary, floors binary, {BLOCK}"
FOUND = "row long, query_id long, vec_id long, score long"


def _chosen_pivots(vectors: DataFrame, pivots: int, scale: int) -> list[np.ndarray]:
    chosen = vectors.select("vector").orderBy(F.xxhash64("id"), "id", "vector").limit(pivots).collect()  # as many rows as pivots
    column = pa.array([r.vector for r in chosen], pa.list_(pa.float64()))
    return [row for _, _, rows in scaled(column, scale) for row in np.split(rows, len(rows))]


def _squared(vectors: np.ndarray, pivots: list[np.ndarray]) -> np.ndarray:
    """Squared distances to the pivots as floats; missing components are 0."""
    own = as_float(squares(vectors))
    return np.stack([own + as_float(squares(p))[0] - 2 * as_float(products(vectors, p))[:, 0] for p in pivots], axis=1)


def _keyed(scale: int, pivots: list[np.ndarray]):
    """Rows ``pivot, away, id, row, dim, kind, data`` with a vector each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own = batch.column("id"), batch.column("row")
            for a, b, vectors in scaled(batch.column("vector"), scale):
                squared = _squared(vectors, pivots)
                near = np.argmin(np.nan_to_num(squared, nan=np.inf), axis=1)
                away = np.sqrt(np.maximum(squared[np.arange(b - a), near], 0))
                stored = [packed(v) for v in np.split(vectors, b - a)]
                columns = [pa.array(near, pa.int32()), pa.array(away), ids.slice(a, b - a), own.slice(a, b - a), *(pa.array(c, t) for c, t in zip(zip(*stored, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=["pivot", "away", "id", "row", "dim", "kind", "data"])

    return run


def _annuli(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def block() -> pa.RecordBatch:
        part, pivot, _, _, _, dim, _, _ = held[0]
        vectors = joined([unpacked(1, dim, r[6], r[7]) for r in held])
        row = (part, pivot, held[0][2], held[-1][2], float(as_float(squares(vectors)).max()), len(held), np.array([r[3] for r in held], "<i8").tobytes(), np.array([r[4] for r in held], "<i8").tobytes(), *packed(vectors))
        return _table([row], INDEX)

    for batch in batches:
        for row in rows_of(batch, "part", "pivot", "away", "id", "row", "dim", "kind", "data"):
            if held and (held[0][:2] != row[:2] or held[0][5] != row[5] or len(held) == ANNULUS or (len(held) + 1) * row[5] > LARGEST):
                yield block()
                held.clear()
            held.append(row)
    if held:
        yield block()


KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.strip().split(" ") for f in schema.split(",")]
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def build_index(vectors: DataFrame, pivots: list[np.ndarray], scale: int) -> DataFrame:
    """The annuli of all vectors (``id, row, vector``), written to the shared folder."""
    keyed = vectors.mapInArrow(_keyed(scale, pivots), f"pivot int, away double, id long, row long, {BLOCK}")
    order = ("pivot", "dim", "away", "id", "row")
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(ordered.withColumn("part", F.spark_partition_id()).mapInArrow(_annuli, INDEX), "annuli")


def bounds(lengths: np.ndarray, away: np.ndarray, least, most, length) -> np.ndarray:
    """No score of vectors between two distances from a pivot is above this, of queries with these squared lengths and distances."""
    gap = np.maximum(np.maximum(away - most, least - away), 0.0)
    with np.errstate(invalid="ignore", over="ignore"):
        gap = np.maximum(gap - 1e-6 * (1 + away + np.sqrt(lengths) + np.sqrt(length)), 0.0)
        bound = (lengths + length - gap * gap) / 2
        return np.nan_to_num(bound + 1 + 1e-9 * (lengths + length), nan=np.inf)


class Parts:
    """What the driver knows of the parts of the index: least and largest distance, largest squared length, number of vectors."""

    def __init__(self, index: DataFrame):
        found = index.groupBy("part", "pivot").agg(F.min("least"), F.max("most"), F.max("length"), F.sum("n")).orderBy("part", "pivot").collect()
        self.keys = [tuple(r)[:2] for r in found]
        self.least, self.most, self.length, self.n = (np.array([tuple(r)[i] for r in found], float) for i in (2, 3, 4, 5))
        self.pivot = np.array([p for _, p in self.keys], int)

    def bounds(self, vectors: np.ndarray, pivots: list[np.ndarray]) -> np.ndarray:
        away = np.sqrt(np.maximum(_squared(vectors, pivots), 0))[:, self.pivot]
        return bounds(as_float(squares(vectors))[:, None], away, self.least, self.most, self.length)


def _first_parts(parts: Parts, pivots: list[np.ndarray], every):
    """Blocks of queries out of the index, each sent to the part with the largest bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, ids, rows, dim, kind, data in rows_of(batch, "n", "ids", "rows", "dim", "kind", "data"):
                ids = np.frombuffer(ids, "<i8")
                asked = np.flatnonzero(every(ids))
                if len(asked):
                    vectors, rows = unpacked(n, dim, kind, data)[asked], np.frombuffer(rows, "<i8")[asked]
                    best = np.argmax(parts.bounds(vectors, pivots), axis=1)
                    yield from _sent(parts, ids[asked], rows, vectors, np.full(len(asked), -np.inf), [(p, np.flatnonzero(best == p)) for p in np.unique(best)])

    return run


def _other_parts(parts: Parts, pivots: list[np.ndarray]):
    """Blocks of queries that searched one part, each sent to all others whose bound reaches the k-th score found there."""
    place = {key: i for i, key in enumerate(parts.keys)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, pivot, n, ids, rows, floors, dim, kind, data in rows_of(batch, *(f.split()[0] for f in WANTED.split(", "))):
                vectors, floors = unpacked(n, dim, kind, data), np.frombuffer(floors, "<f8")
                may = parts.bounds(vectors, pivots) >= floors[:, None]
                may[:, place[part, pivot]] = False
                yield from _sent(parts, np.frombuffer(ids, "<i8"), np.frombuffer(rows, "<i8"), vectors, floors, [(p, np.flatnonzero(may[:, p])) for p in np.flatnonzero(may.any(axis=0))])

    return run


def _sent(parts: Parts, ids, rows, vectors, floors, to: list) -> Iterator[pa.RecordBatch]:
    for p, members in to:
        for a in range(0, len(members), QUERIES):
            m = members[a : a + QUERIES]
            yield _table([(*parts.keys[p], len(m), ids[m].tobytes(), rows[m].tobytes(), floors[m].astype("<f8").tobytes(), *packed(vectors[m]))], WANTED)


class _Search:
    """Best k of each query of a block over the annuli it met so far."""

    def __init__(self, n, ids, rows, floors, dim, kind, data, pivot: np.ndarray, k: int):
        self.ids, self.rows, self.k = np.frombuffer(ids, "<i8"), np.frombuffer(rows, "<i8"), k
        self.vectors, self.floors = unpacked(n, dim, kind, data), np.frombuffer(floors, "<f8").copy()
        self.lengths = as_float(squares(self.vectors))
        self.away = np.sqrt(np.maximum(_squared(self.vectors, [pivot])[:, 0], 0))
        self.best: list[list[tuple[int, int]]] = [[] for _ in range(n)]

    def meet(self, least: float, most: float, length: float, ids: np.ndarray, load) -> None:
        open_ = np.flatnonzero(bounds(self.lengths, self.away, least, most, length) >= self.floors)
        if not len(open_):
            return
        scores = products(self.vectors[open_], load())
        if scores.dtype == object:
            scores = np.array([as_long(x) for x in scores.ravel().tolist()], np.int64).reshape(scores.shape)
        reach = as_float(scores) >= self.floors[open_][:, None]
        reach &= ids[None, :] != self.ids[open_][:, None]
        for at, i in enumerate(open_.tolist()):
            here = np.flatnonzero(reach[at])
            if len(here) > 4 * self.k:
                own = scores[at, here]
                here = here[own >= np.partition(own, len(own) - self.k)[len(own) - self.k]]
            if len(here):
                mine = self.best[i] + list(zip((-scores[at, here].astype(object)).tolist(), ids[here].tolist(), strict=True))
                self.best[i] = sorted(mine)[: self.k]
                if len(self.best[i]) == self.k:
                    self.floors[i] = max(self.floors[i], float(-self.best[i][-1][0]))

    def found(self) -> pa.RecordBatch:
        return _table([(r, q, v, -s) for q, r, best in zip(self.ids.tolist(), self.rows.tolist(), self.best, strict=True) for s, v in best], FOUND)


def _scored(pivots: list[np.ndarray], k: int):
    asked = [f.split()[0] for f in WANTED.split(", ")[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: OrderedDict[tuple, _Search] = OrderedDict()
        for batch in batches:
            for row in zip(*(batch.column(f"q_{c}").to_pylist() for c in asked), *(batch.column(c).to_pylist() for c in ("part", "pivot", "least", "most", "length", "n", "ids", "dim", "kind", "data")), strict=True):
                wanted, (part, pivot, least, most, length, n, ids, dim, kind, data) = row[:7], row[7:]
                key = (part, pivot, wanted[2])
                if key not in open_:
                    if len(open_) == OPEN:
                        yield open_.popitem(last=False)[1].found()
                    open_[key] = _Search(*wanted, pivots[pivot], k)
                open_.move_to_end(key)
                open_[key].meet(least, most, length, np.frombuffer(ids, "<i8"), lambda n=n, dim=dim, kind=kind, data=data: unpacked(n, dim, kind, data))
        for search in open_.values():
            yield search.found()

    return run


def _searched(wanted: DataFrame, index: DataFrame, pivots: list[np.ndarray], k: int) -> DataFrame:
    sent = wanted.select("part", "pivot", *(F.col(c).alias(f"q_{c}") for c in wanted.columns[2:]))
    annuli = index.select("part", "pivot", "least", "most", "length", "n", "ids", "dim", "kind", "data")
    return sent.join(annuli, ["part", "pivot"]).mapInArrow(_scored(pivots, k), FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id", "row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of queries with the k-th scores found so far; ``lows`` holds pairs of row and score."""
    names = [f.split()[0] for f in WANTED.split(", ")]
    for batch in batches:
        out = []
        for *given, lows in rows_of(batch, *names, "lows"):
            low = {x["row"]: x["score"] for x in lows or ()}
            rows = np.frombuffer(given[names.index("rows")], "<i8").tolist()
            given[names.index("floors")] = np.array([float(low[r]) if r in low else -np.inf for r in rows], "<f8").tobytes()
            out.append(tuple(given))
        yield _table(out, WANTED)


def top_k(rows: DataFrame, id_: str, vector: str, every: int = 100, k: int = 10, scale: int = 1024, pivots: int = PIVOTS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best of all other rows for each row whose id is divisible by ``every``."""
    bounded_batches(rows.sparkSession)
    vectors = rows.select(F.col(id_).alias("id"), F.col(vector).alias("vector")).where(F.col("id").isNotNull() & whole(F.col("vector")))
    vectors = vectors.withColumn("row", F.monotonically_increasing_id())
    points = _chosen_pivots(vectors, pivots, scale)
    if not points:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    index = build_index(vectors, points, scale)
    parts = Parts(index)
    asked = lambda ids: ids % every == 0
    first = stage(index.select("n", "ids", "rows", "dim", "kind", "data").mapInArrow(_first_parts(parts, points, asked), WANTED), "queries")
    seen = stage(_searched(first, index, points, k), "found")
    last = F.max_by("score", "rank")
    lows = _best(seen, k).groupBy("query_id", "row").agg(last.alias("score"), F.max("rank").alias("n")).where(F.col("n") == k)
    wanted = _with_floors(first, lows).mapInArrow(_floors, WANTED).mapInArrow(_other_parts(parts, points), WANTED)
    others = _searched(wanted, index, points, k)
    return _best(seen.unionByName(others), k).select("query_id", "rank", "vec_id", "score")


def _with_floors(first: DataFrame, lows: DataFrame) -> DataFrame:
    """Blocks of queries with the k-th scores of those of their queries that have one."""
    members = first.select("part", "pivot", "rows").mapInArrow(_members, "block binary, row long")
    per_block = members.join(lows.select("row", "score"), "row").groupBy("block").agg(F.collect_list(F.struct("row", "score")).alias("lows"))
    return first.withColumn("block", F.col("rows")).join(per_block, "block", "left").select(*first.columns, "lows")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for (rows,) in rows_of(batch, "rows"):
            own = np.frombuffer(rows, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array([rows] * len(own), pa.binary()), pa.array(own, pa.int64())], names=["block", "row"])
