"""Listings of materials and of followed sources: search, chosen and pinned creators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACES, WHITE, strip

# The fields that a search looks through.
MATERIAL = ("title", "creator", "source_id", "source_url", "stage", "text_source")
SOURCE = ("name", "mid", "sign", "official_title")


def creator_name(name: Column) -> Column:
    """A name as it is compared: trimmed, single spaces, lower case; null is empty."""
    return F.lower(F.regexp_replace(strip(name), WHITE, " "))


def read_path(*outputs: tuple[Column, Column]) -> Column:
    """The path of the first output (exists, path) that exists and has one, else empty."""
    return F.coalesce(*(F.when(exists & (path != ""), path) for exists, path in outputs), F.lit(""))


def searched(rows: DataFrame, query: str, fields: tuple[str, ...]) -> DataFrame:
    """Rows whose fields, joined by spaces, hold the query whatever the case; all for a blank one."""
    wanted = query.strip(SPACES)
    text = F.concat_ws(" ", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields))
    return rows.where(F.contains(F.lower(text), F.lower(F.lit(wanted)))) if wanted else rows


def materials(records: DataFrame, query: str = "", creator: str | None = None, pinned: DataFrame | None = None) -> DataFrame:
    """Records with a ``read_path`` that match the query: of one ``creator``, or of none that ``pinned`` names.

    Records without a creator belong to no pinned one, so they stay with ``pinned``; blank pinned names count for nothing.
    """
    rows = searched(records.where(F.col("read_path") != ""), query, MATERIAL)
    if creator is not None:
        rows = rows.where(creator_name(F.col("creator")) == creator_name(F.lit(creator)))
    if pinned is not None:
        names = pinned.select(creator_name(F.col("name")).alias("pinned_name")).where(F.col("pinned_name") != "").distinct()
        rows = rows.join(names, creator_name(rows["creator"]) == names["pinned_name"], "left_anti")
    return rows


def sources(items: DataFrame, pinned: DataFrame, query: str = "", pinned_only: bool = False) -> DataFrame:
    """Followed sources that match the query, with ``pinned``: pinned ones first, each part in the order of ``position``."""
    marks = pinned.select(F.col("mid").alias("pinned_mid")).where(F.col("pinned_mid").isNotNull()).distinct()
    found = searched(items, query, SOURCE)
    rows = found.join(marks, found["mid"] == marks["pinned_mid"], "inner" if pinned_only else "left").withColumn("pinned", marks["pinned_mid"].isNotNull()).drop(marks["pinned_mid"])
    return rows.orderBy(F.desc("pinned"), "position")
