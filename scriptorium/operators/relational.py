"""Joins, upserts and ordered picks that keep a stated order of preference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import micros


def unknown_rows(rows: DataFrame, key: str, *known: DataFrame) -> DataFrame:
    """Rows whose key is in none of the one-column tables of known keys."""
    keys = known[0].toDF(key)
    for k in known[1:]:
        keys = keys.unionByName(k.toDF(key))
    return rows.join(keys, key, "left_anti")


def first_match(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], left_id: str, position: str) -> DataFrame:
    """Left join on any of several equalities; the match that stands first in ``right`` wins.

    An OR-join is planned as a nested loop; a union of equi-joins with a minimum is not.
    """
    hits = [left.select(left_id, F.col(a).alias("__k")).join(right.select(F.col(b).alias("__k"), position), "__k").select(left_id, position) for a, b in pairs]
    both = hits[0]
    for h in hits[1:]:
        both = both.unionByName(h)
    first = both.groupBy(left_id).agg(F.min(position).alias(position))
    return left.join(first, left_id, "left").join(right, position, "left")


def upsert(stored: DataFrame, fresh: DataFrame, key: str, keep: list[str], filled: list[str], plain: list[str]) -> DataFrame:
    """Merge by key; nothing is deleted.

    ``keep``: the stored value wins; ``filled``: an empty or null fresh text falls back to the stored one;
    ``plain``: only a null falls back, so that 0 overwrites.
    """
    old, new = stored.alias("o"), fresh.alias("n")
    pick: dict[str, Column] = {c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) for c in keep}
    pick |= {c: F.coalesce(F.expr(f"nullif(n.{c}, '')"), F.col(f"o.{c}"), F.col(f"n.{c}")) for c in filled}
    pick |= {c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) for c in plain}
    joined = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    return joined.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *(c.alias(n) for n, c in pick.items()))


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)


def page(rows: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    """A page of the ordered rows, the page number clamped to what exists; sorts once, counts once."""
    total = rows.count()
    number = max(1, min(number, -(-total // size)))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).withColumn("page", F.lit(number).cast("int"))


def streak(events: DataFrame, group: str, at: str, as_of: Column, gap_seconds: int = 5400, stale_seconds: int = 43200) -> DataFrame:
    """Length of each group's newest run whose gaps are at most ``gap_seconds``; 0 if the newest is stale at ``as_of``."""
    w = Window.partitionBy(group).orderBy(F.col(at).desc())
    seconds = micros(F.col(at)) / 1e6
    broken = events.withColumn("__gap", F.coalesce(F.lag(seconds).over(w) - seconds, F.lit(0.0)))
    runs = broken.withColumn("__breaks", F.sum((F.col("__gap") > gap_seconds).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    fresh = (micros(as_of) - micros(F.max(at))) / 1e6 <= stale_seconds
    return runs.groupBy(group).agg(F.when(fresh, F.sum((F.col("__breaks") == 0).cast("long"))).otherwise(0).alias("streak"))


def reusable(expected: DataFrame, stored: DataFrame, group: str, name: str, key: str, ok: str) -> DataFrame:
    """group, reusable: whether every expected artifact is stored under its key and in order (``ok``, a boolean column).

    A stored artifact that repeats counts if one of its rows fits; a null key fits nothing.
    """
    fit = stored.where(F.col(ok)).select(group, name, key).distinct().withColumn("__fit", F.lit(True))
    return expected.join(fit, [group, name, key], "left").groupBy(group).agg(F.bool_and(F.col("__fit").isNotNull()).alias("reusable"))


def changed_rows(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` that ``old`` lacks or holds with other values: what a sink has to write; nulls are equal."""
    values = [c for c in new.columns if c != key]
    before = old.select(key, F.struct(*values).alias("__before"))
    return new.join(before, key, "left").where(~F.struct(*values).eqNullSafe(F.col("__before"))).drop("__before")
