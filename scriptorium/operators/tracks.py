"""Subtitle tracks as rows: regrouping by page, merging two sets of tracks, times of labelled chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import page_number
from ..functions.text import strip


def page_groups(segments: DataFrame, track: list[str], order: str) -> DataFrame:
    """A row for each track, page and label: its place among the track's groups, its entries in order.

    ``segments``: page, label, from, to, text and ``order``.  A missing or zero page is 1, an empty label the
    page's; segments without text are dropped, and a track with none has no row.
    """
    page = F.when(F.coalesce("page", F.lit(0)) == 0, 1).otherwise(F.col("page"))
    label = strip(F.col("label"))
    rows = segments.withColumns({"page": page, "text": strip(F.col("text"))}).where("text <> ''")
    rows = rows.withColumn("label", F.when(label == "", F.concat(F.lit("P"), F.col("page").cast("string"))).otherwise(label))
    entry = F.struct(F.col(order).alias("at"), F.coalesce("from", F.lit(0.0)).alias("from"), F.coalesce("to", F.lit(0.0)).alias("to"), "text")
    groups = rows.groupBy(*track, "page", "label").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    place = F.row_number().over(Window.partitionBy(*track).orderBy(F.col("entries")[0]["at"]))
    return groups.withColumn("place", place)


def merged(base: DataFrame, incoming: DataFrame, track: list[str], order: str) -> DataFrame:
    """Entries of both sets by track, ``base`` first, with ``place`` from 1.

    ``paged`` (boolean) tells entries of page segments from flat ones.  In a track with any page segments the
    flat entries give way and the rest follow by page, taken from the label where the page is missing or 0.
    """
    both = base.withColumn("__set", F.lit(0)).unionByName(incoming.withColumn("__set", F.lit(1)))
    by_page = F.max(F.col("paged").cast("int")).over(Window.partitionBy(*track)) == 1
    page = F.when(F.coalesce("page", F.lit(0)) == 0, page_number(F.col("label"))).otherwise(F.col("page"))
    kept = both.withColumns({"__by_page": by_page, "__page": F.when(F.col("paged"), page).otherwise(0)}).where("paged or not __by_page")
    place = F.row_number().over(Window.partitionBy(*track).orderBy("__page", "__set", order))
    return kept.withColumn("place", place).drop("__by_page", "__page", "__set")


def chunk_times(chunks: DataFrame, segments: DataFrame, group: str, chunk: str, labels: str) -> DataFrame:
    """group, chunk, from, to: the range of the group's segments under a chunk's labels, of all if it has none.

    A missing time is 0; a chunk whose labels name no segment has a null range.
    """
    times = segments.groupBy(group, "label").agg(F.min(F.coalesce("from", F.lit(0.0))).alias("from"), F.max(F.coalesce("to", F.lit(0.0))).alias("to"))
    whole = times.groupBy(group).agg(F.min("from").alias("__from"), F.max("to").alias("__to"))
    named = F.array_distinct(F.filter(F.transform(F.coalesce(labels, F.array().cast("array<string>")), strip), lambda x: x != ""))
    asked = chunks.select(group, chunk, F.explode_outer(named).alias("label"))
    found = asked.join(times, [group, "label"], "left").join(whole, group, "left")
    pick = lambda own, all_: F.when(F.col("label").isNull(), F.col(all_)).otherwise(F.col(own))
    return found.groupBy(group, chunk).agg(F.min(pick("from", "__from")).alias("from"), F.max(pick("to", "__to")).alias("to"))
