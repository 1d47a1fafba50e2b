"""Paged backfill as a table of cursors, and run states as mergeable patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def has_more(fetched, size: int, page, total):
    """A full page, and no known total that it reaches."""
    return (fetched >= size) & (total.isNull() | (page * size < total))


def next_pages(cursors: DataFrame, listed: DataFrame, source: str, order: list, size: int, total: str | None = "total") -> tuple[DataFrame, DataFrame]:
    """One step of all sources that have more: the rows of their next page, and the cursors after it.

    ``cursors``: ``source, page, more`` (page 0 before the first) and a total, null where unknown.  ``listed`` is what
    the provider holds; a page is a slice of its order, so that a step reads all sources at once, and a stop between
    two steps loses nothing: the cursors are a table.  A source that has no more keeps its cursor.
    """
    nth = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    open_ = cursors.where("more").select(source, (F.col("page") + 1).alias("page"))
    ranked = listed.withColumn("page", F.floor((nth - 1) / size) + 1)
    fetched = ranked.join(open_, [source, "page"])
    counts = fetched.groupBy(source).agg(F.count("*").alias("fetched"))
    known = F.col(total) if total else F.lit(None).cast("long")
    after = cursors.join(counts, source, "left").withColumn("fetched", F.when(F.col("more"), F.coalesce("fetched", F.lit(0))))
    page = F.col("page") + F.col("more").cast("int")
    more = F.col("more") & F.coalesce(has_more(F.col("fetched"), size, page, known), F.lit(False))
    return fetched, after.select(*(F.col(c) if c not in ("page", "more") else {"page": page, "more": more}[c].alias(c) for c in cursors.columns))


#: What a run's status makes of a stage, and of its step.
READY, REVIEW, FAILED = "local_consumption_ready", "local_consumption_needs_review", "local_consumption_failed"


def stage_of(status, quality_ok):
    """Ready if all is well, to be reviewed if the run says so or quality does, else failed; unknown quality is no objection."""
    fine = F.coalesce(quality_ok, F.lit(True))
    return F.when((status == "ok") & fine, READY).when(status.isin("ok", "needs_review"), REVIEW).otherwise(FAILED)


def run_states(patches: DataFrame, key: str, order: str) -> DataFrame:
    """key, stage, completed, steps: the state of each run after all its patches.

    ``patches``: ``stage`` and ``step`` with ``step_status`` (each null for none), and ``add`` and ``remove``, names of completed
    stages.  The last stage wins; a step replaces that of its id and goes to the end; a completed stage keeps its place while it
    is in the set, and takes a new one after a removal.  Patches with equal ``order`` are the caller's fault; a removal
    comes before an addition of the same patch.  Each part is an aggregate that merges in any grouping of the
    patches (a largest order, a least order since), so partial sums meet in any order and a run of any number of patches
    costs a row for each name it uses.
    """
    stages = patches.groupBy(key).agg(F.max_by("stage", F.when(F.col("stage").isNotNull(), F.col(order))).alias("stage"))
    steps = patches.where("step is not null").groupBy(key, "step").agg(F.max_by(F.struct(F.col(order).alias("at"), "step", F.col("step_status").alias("status")), order).alias("s"))
    steps = steps.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: F.concat_ws("=", s["step"], s["status"])).alias("steps"))
    gone = patches.where("remove is not null").groupBy(key, F.col("remove").alias("name")).agg(F.max(order).alias("gone"))
    added = patches.where("add is not null").select(key, F.col("add").alias("name"), F.col(order).alias("at"))
    alive = added.join(gone, [key, "name"], "left").where("gone is null or at >= gone").groupBy(key, "name").agg(F.min("at").alias("at"))
    completed = alive.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda s: s["name"]).alias("completed"))
    none = F.array().cast("array<string>")
    return stages.join(completed, key, "left").join(steps, key, "left").select(key, "stage", F.coalesce("completed", none).alias("completed"), F.coalesce("steps", none).alias("steps"))
