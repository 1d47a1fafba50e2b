"""A query and helpers to define them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(value: object) -> str:
    """A SQL literal."""
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, int | float) else "'" + str(value).replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    """A SQL subquery with literal rows."""
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) AS v({names}))"
