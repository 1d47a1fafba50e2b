"""Folds over the rows of a group in their order, in bounded memory.

Rows are dealt by group and sorted by group and order; each task then reads Arrow batches and carries the
state of one group at a time over their edges.  A group of any size costs one state and one batch, so a
package that holds a third of all rows takes time in one task, but no memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructType


class Fold(Protocol):
    """The state of a group: ``take`` sees its rows in order, ``end`` comes after the last; both return rows to emit."""

    def take(self, *values: Any) -> Iterable[tuple]: ...

    def end(self) -> Iterable[tuple]: ...


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> None:
    """Batches that hold long texts stay small; plans read these settings when they run, so they stay in the session unless smaller ones are set."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def _sorted(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    small_batches(rows.sparkSession)
    return rows.repartition(*group).sortWithinPartitions(*group, *order)


def _typed(rows: DataFrame, names: list[str]) -> str:
    kinds: dict[str, DataType] = {f.name: f.dataType for f in rows.schema.fields}
    return ", ".join(f"`{n}` {kinds[n].simpleString()}" for n in names)


_NONE = object()


def fold(rows: DataFrame, group: list[str], order: list[str], values: list[str], start: Callable[[], Fold], schema: str) -> DataFrame:
    """The group's columns and what its fold emits (``schema``), from the columns ``values`` of each row."""
    shown = to_arrow_schema(StructType.fromDDL(schema))
    names, types = shown.names, shown.types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: Any = _NONE
        state: Fold | None = None
        kinds: list[pa.DataType] = []

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), [*kinds, *types], strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=[*group, *names])

        for batch in batches:
            kinds = [batch.column(g).type for g in group]
            out: list[tuple] = []
            keys = zip(*(batch.column(g).to_pylist() for g in group), strict=True)
            for k, given in zip(keys, zip(*(batch.column(v).to_pylist() for v in values), strict=True), strict=True):
                if k != key:
                    if state is not None:
                        out += [(*key, *r) for r in state.end()]
                    key, state = k, start()
                out += [(*k, *r) for r in state.take(*given)]
            if out:
                yield batch_of(out)
        if state is not None and (out := [(*key, *r) for r in state.end()]):
            yield batch_of(out)

    dealt = _sorted(rows.select(*dict.fromkeys([*group, *order, *values])), group, order)
    return dealt.mapInArrow(run, f"{_typed(rows, group)}, {schema}")


def running(rows: DataFrame, group: list[str], order: list[str], value: str, start: Callable[[], Any], step: Callable[[Any, Any], tuple[Any, int]], name: str) -> DataFrame:
    """``rows`` with an int column more: ``step(state, value)`` returns the next state and what the row shows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: Any = _NONE
        state: Any = None
        for batch in batches:
            out = []
            keys = zip(*(batch.column(g).to_pylist() for g in group), strict=True)
            for k, x in zip(keys, batch.column(value).to_pylist(), strict=True):
                if k != key:
                    key, state = k, start()
                state, shown = step(state, x)
                out.append(shown)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=[*batch.schema.names, name])

    return _sorted(rows, group, order).mapInArrow(run, f"{_typed(rows, rows.columns)}, `{name}` int")
