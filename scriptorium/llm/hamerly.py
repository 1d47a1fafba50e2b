"""Centroid clustering by Hamerly's bounds, exact in integers.

Vectors are packed into blocks once and stay where they were read; no round shuffles them.  A block
carries for each vector its cluster, an upper bound of the distance to its centroid and a lower bound of
that to the second nearest, besides the sums of its clusters.  A round loosens the bounds by the drift of
the centroids; a vector whose upper bound is below the lower one, or below half the distance from its
centroid to the next, keeps its cluster; others first tighten the upper bound and, if still ambiguous, are
compared with all centroids in whole numbers.  Bounds are floats rounded outwards, so that they never
decide a tie.  Each round is a table in the shared folder; the sums are read from it without the vectors,
added by cluster, and only the centroids, a fixed number, reach the driver.

Cases: vectors that are null, of another length, or hold null or non-finite components are left out; with
fewer kept vectors than clusters each starts a centroid; ties go to the smaller number; a centroid without
vectors stays; rows that repeat are vectors of their own, those that tie as first centroids are ordered by
their components, a null id comes last; an empty table gives no rows.  Distances and inertias beyond a long are shown as the
largest long.  Of the columns only id and vector are read.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, drop, rows_of, stage
from .vectors import BLOCK, as_float, as_long, joined, packed, products, scaled, squares, unpacked, whole

ROWS = 2048  # vectors in a block
UP, DOWN = 1 + 1e-12, 1 - 1e-12
LARGEST = 1e300
STATE = f"n int, {BLOCK}, clusters binary, upper binary, lower binary, scanned long, sums string, counts string, distances string, inertia string"


class Centroids:
    """Centroids of one round, how far each moved, and half the distance to its nearest neighbour."""

    def __init__(self, rows: list[list[int]], before: Centroids | None = None):
        self.rows = rows
        self.points = _exact(rows)
        k = len(rows)
        apart = _distances(self.points, self.points)
        self.half = np.array([min((_root(apart[i][j]) for j in range(k) if j != i), default=LARGEST) for i in range(k)]) / 2 * DOWN
        self.drift = np.zeros(k)
        if before is not None:
            self.drift = np.array([_root(sum((x - y) ** 2 for x, y in zip(a, b, strict=True))) for a, b in zip(rows, before.rows, strict=True)]) * UP
        #: For each centroid the largest drift of the others.
        self.others = np.array([max((self.drift[j] for j in range(k) if j != i), default=0.0) for i in range(k)])


def _exact(rows: list[list[int]]) -> np.ndarray:
    largest = max((abs(x) for r in rows for x in r), default=0)
    return np.array(rows, np.int64 if largest <= 1 << 26 else object)


def _root(squared: int) -> float:
    squared = int(squared)
    return math.sqrt(squared) if squared < 2**1000 else float(min(math.isqrt(squared), 2**996))


def _distances(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to all points."""
    cross, own, theirs = products(vectors, points), squares(vectors), squares(points)
    if object in (cross.dtype, own.dtype, theirs.dtype):
        cross, own, theirs = (x.astype(object) for x in (cross, own, theirs))
    return own[:, None] + theirs[None, :] - 2 * cross


def _own(vectors: np.ndarray, points: np.ndarray, clusters: np.ndarray) -> np.ndarray:
    """Exact squared distance of each vector to the point of its cluster."""
    target = points[clusters]
    if object in (vectors.dtype, target.dtype):
        vectors, target = vectors.astype(object), target.astype(object)
    return squares(vectors - target)


def _bound(squared: np.ndarray, rounded: float) -> np.ndarray:
    return np.minimum(np.sqrt(as_float(squared)) * rounded, LARGEST)


def nearest(vectors: np.ndarray, centroids: Centroids, clusters=None, upper=None, lower=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Clusters and bounds against ``centroids``, and how many vectors were compared with all of them."""
    points = centroids.points
    if clusters is None:
        clusters, upper, lower = np.zeros(len(vectors), np.int64), np.full(len(vectors), LARGEST), np.zeros(len(vectors))
        unsure = np.arange(len(vectors))
    else:
        clusters = clusters.astype(np.int64)
        upper = np.minimum((upper + centroids.drift[clusters]) * UP, LARGEST)
        lower = np.maximum((lower - centroids.others[clusters]) * DOWN, 0.0)
        safe = np.maximum(lower, centroids.half[clusters])
        unsure = np.flatnonzero(upper >= safe)
        upper[unsure] = _bound(_own(vectors[unsure], points, clusters[unsure]), UP)
        unsure = unsure[upper[unsure] >= safe[unsure]]
    if len(unsure):
        all_ = _distances(vectors[unsure], points)
        best = np.argmin(all_, axis=1)
        clusters[unsure] = best
        least = all_[np.arange(len(unsure)), best]
        upper[unsure] = _bound(least, UP)
        if len(points) > 1:
            rest = as_float(all_)
            rest[np.arange(len(unsure)), best] = np.inf
            lower[unsure] = np.minimum(np.sqrt(rest.min(axis=1)) * DOWN, LARGEST)
        else:
            lower[unsure] = LARGEST
    return clusters, upper, lower, len(unsure)


def _state(vectors: np.ndarray, stored: tuple, centroids: Centroids, last: bool, clusters=None, upper=None, lower=None) -> list:
    """The columns of ``STATE`` of a block."""
    clusters, upper, lower, scanned = nearest(vectors, centroids, clusters, upper, lower)
    k = len(centroids.rows)
    counts = np.bincount(clusters, minlength=k).tolist()
    sums = distances = inertia = None
    if last:
        exact = _own(vectors, centroids.points, clusters).tolist()
        inertia = [0] * k
        for c, x in zip(clusters.tolist(), exact, strict=True):
            inertia[c] += x
        distances, inertia = json.dumps(exact), json.dumps(inertia)
    else:
        sums = json.dumps([vectors[clusters == c].sum(axis=0).tolist() if n else None for c, n in enumerate(counts)])
    return [len(vectors), *stored, clusters.astype("<u2").tobytes(), upper.astype("<f8").tobytes(), lower.astype("<f8").tobytes(), scanned, sums, json.dumps(counts), distances, inertia]


def _batch(rows: list[list], ids: list[pa.Array]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), *[pa.string()] * 4)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    columns = [pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(ids)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))]
    return pa.RecordBatch.from_arrays(columns, names=["ids", *(f.split()[0] for f in STATE.split(", "))])


def _first(scale: int, centroids: Centroids, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        held: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            vectors = joined(held)
            return _batch([_state(vectors, packed(vectors), centroids, last)], [pa.concat_arrays(ids)])

        for batch in batches:
            for a, b, rows in scaled(batch.column("vector"), scale):
                if held and sum(map(len, held)) + b - a > ROWS:
                    yield block()
                    ids.clear(), held.clear()
                ids.append(batch.column("id").slice(a, b - a))
                held.append(rows)
        if held:
            yield block()

    return run


def _next(centroids: Centroids, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (n, dim, kind, data, clusters, upper, lower) in enumerate(rows_of(batch, "n", "dim", "kind", "data", "clusters", "upper", "lower")):
                bounds = (np.frombuffer(clusters, "<u2"), np.frombuffer(upper, "<f8"), np.frombuffer(lower, "<f8"))
                yield _batch([_state(unpacked(n, dim, kind, data), (dim, kind, data), centroids, last, *bounds)], [batch.column("ids").slice(i, 1).flatten()])

    return run


def _added(state: DataFrame, column: str) -> dict[int, tuple[int, list[int] | int]]:
    """Of each cluster the number of vectors and the sum of ``column`` over all blocks, in whole numbers.

    A task adds its blocks; what a cluster has of each task is added in one place, a row a task.
    """

    def rows(sums: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"cluster": pa.array(list(sums), pa.int32()), "total": pa.array([json.dumps(x) for x in sums.values()], pa.string())})

    def into(sums: dict, c: int, n: int, x) -> None:
        if c not in sums:
            sums[c] = [n, x]
        else:
            m, y = sums[c]
            sums[c] = [m + n, [p + q for p, q in zip(x, y, strict=True)] if isinstance(x, list) else x + y]

    def blocks(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for counts, totals in rows_of(batch, "counts", column):
                for c, (n, x) in enumerate(zip(json.loads(counts), json.loads(totals), strict=True)):
                    if n:
                        into(sums, c, n, x)
        yield rows(sums)

    def tasks(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for c, total in rows_of(batch, "cluster", "total"):
                into(sums, c, *json.loads(total))
        yield rows(sums)

    schema = "cluster int, total string"
    found = state.select("counts", column).mapInArrow(blocks, schema).repartition("cluster").mapInArrow(tasks, schema)
    return {r.cluster: tuple(json.loads(r.total)) for r in found.collect()}  # a row a cluster


def _started(kept: DataFrame, k: int, seed: str, scale: int) -> list[list[int]]:
    """The vectors with the smallest hashes of seed and id, in that order."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("hash")
    chosen = kept.select(hashed, "vector").orderBy(F.col("hash").asc_nulls_last(), "vector").limit(k).collect()  # k rows
    column = pa.array([r.vector for r in chosen], pa.list_(pa.float64()))
    return [x for _, _, rows in scaled(column, scale) for x in rows.tolist()]


def cluster(rows: DataFrame, id_: str, vector: str, dim: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, seed: str = "1") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector after ``rounds`` rounds and a last assignment."""
    bounded_batches(rows.sparkSession)
    key = dict(rows.dtypes)[id_]
    schema = f"id {key}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    kept = rows.select(F.col(id_).alias("id"), F.col(vector).alias("vector")).where((F.size("vector") == dim) & whole(F.col("vector")))
    start = _started(kept, k, seed, scale)
    if not start:
        return rows.sparkSession.createDataFrame([], schema.replace("id ", f"{id_} ", 1))
    blocks = f"ids array<{key}>, {STATE}"
    centroids = Centroids(start)
    state = stage(kept.mapInArrow(_first(scale, centroids, rounds == 0), blocks), "hamerly")
    for r in range(rounds):
        sums = _added(state, "sums")
        moved = [[x // sums[c][0] for x in sums[c][1]] if c in sums else old for c, old in enumerate(centroids.rows)]
        centroids = Centroids(moved, centroids)
        after = stage(state.mapInArrow(_next(centroids, r + 1 == rounds), blocks), "hamerly")
        drop(state)
        state = after
    inertia = {c: x for c, (_, x) in _added(state, "inertia").items()}
    total = as_long(sum(inertia.values()))
    hashes = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.rows]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (clusters, distances) in enumerate(rows_of(batch, "clusters", "distances")):
                of = np.frombuffer(clusters, "<u2").tolist()
                far = [as_long(x) for x in json.loads(distances)]
                columns = [pa.array(of, pa.int32()), pa.array(far, pa.int64()), pa.array([as_long(inertia[c]) for c in of], pa.int64()), pa.array([total] * len(of), pa.int64()), pa.array([hashes[c] for c in of], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column("ids").slice(i, 1).flatten(), *columns], names=["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return state.select("ids", "clusters", "distances").mapInArrow(spread, schema).withColumnRenamed("id", id_)
