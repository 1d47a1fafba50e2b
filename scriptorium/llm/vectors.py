"""Vectors of integers in blocks: exact conversion, storage and arithmetic that the vector operators share.

Components of at most ``NARROW`` in size are kept as int16 or int32 and computed as int64, or as float64
where every sum stays below 2**53 and is exact; larger ones are kept as decimal text and computed as
Python integers, so that no result overflows on the way.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

NARROW = 1 << 26
LONGEST = (1 << 63) - 1
BLOCK = "dim int, kind int, data binary"


def whole(vector: Column) -> Column:
    """Whether a vector is there and holds finite numbers only; an empty one does."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite, F.lit(False))


def scaled(column: pa.Array, scale: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Runs of rows of one length: first row, row after the last, floor(scale * x) as int64 or Python integers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    places = np.concatenate([[0], np.cumsum(sizes)])
    cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a == b:
            continue
        x = flat[places[a] : places[b]].reshape(b - a, int(sizes[a]))
        y = x * scale
        if not y.size or np.abs(y).max() <= NARROW:
            yield a, b, np.floor(y).astype(np.int64)
        else:
            yield a, b, np.array([[math.floor(v * scale) if abs(v) < 2**900 else int(v) * scale for v in row] for row in x.tolist()], object)


def packed(rows: np.ndarray) -> tuple[int, int, bytes]:
    """``dim, kind, data`` of a block: kind is the bytes a component, or 0 for text."""
    if rows.dtype != object:
        kind = 2 if not rows.size or np.abs(rows).max() < 1 << 15 else 4
        return rows.shape[1], kind, rows.astype(f"<i{kind}").tobytes()
    return rows.shape[1], 0, json.dumps(rows.tolist()).encode()


def unpacked(n: int, dim: int, kind: int, data: bytes) -> np.ndarray:
    if kind:
        return np.frombuffer(data, f"<i{kind}").reshape(n, dim).astype(np.int64)
    return np.array(json.loads(data), object).reshape(n, dim)


def joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows; what one vector has beyond the other's length counts nothing."""
    dim = min(a.shape[1], b.shape[1])
    a, b = a[:, :dim], b[:, :dim]
    if object in (a.dtype, b.dtype):
        return a.astype(object) @ b.astype(object).T if dim else np.zeros((len(a), len(b)), object)
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * dim
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    return a.astype(object) @ b.astype(object).T


def squares(a: np.ndarray) -> np.ndarray:
    """Exact squared length of each row."""
    if a.dtype != object and int(np.abs(a).max(initial=0)) ** 2 * a.shape[1] >= 1 << 62:
        a = a.astype(object)
    return (a * a).sum(axis=1) if a.shape[1] else np.zeros(len(a), np.int64)


def as_float(x: np.ndarray) -> np.ndarray:
    """Nearest floats; integers beyond their range become infinite."""
    if x.dtype != object:
        return x.astype(np.float64)
    return np.array([float(v) if abs(v) < 2**1020 else math.copysign(math.inf, v) for v in x.ravel().tolist()]).reshape(x.shape)


def as_long(x) -> int:
    """An integer as a long; beyond its range the largest or smallest one."""
    return max(-LONGEST - 1, min(LONGEST, int(x)))
