"""Tree operators over (id, parent) tables: paths, leaves, dependencies.

Levels are joined one at a time, each level once, until none is left or a given depth is reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.places import stage


def ancestors(nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """id, ancestor, distance for every node and each of its ancestors, itself included; ``depth`` bounds the distance."""
    edges = nodes.select(F.col("id").alias("__id"), F.col("parent").alias("__up"))
    level = nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance"))
    out, d, most = level, 0, nodes.count() if depth is None else depth
    while d < most:
        d += 1
        level = level.join(edges, F.col("ancestor") == F.col("__id")).where("__up is not null").select("id", F.col("__up").alias("ancestor"), F.lit(d).alias("distance"))
        if depth is None:
            # cuts the lineage; a tree has fewer levels than nodes, so that a cycle ends too
            level = stage(level, "level")
            if level.isEmpty():
                break
        out = out.unionByName(level)
    return out


def _leaves(nodes: DataFrame, study: str | None) -> DataFrame:
    """The leaves: nodes that ``study`` (a boolean column) marks, or those without children."""
    if study:
        return nodes.where(F.col(study)).select("id")
    parents = nodes.where("parent is not null").select(F.col("parent").alias("id")).distinct()
    return nodes.select("id").join(parents, "id", "left_anti")


def met(nodes: DataFrame, edges: DataFrame, completed: DataFrame, depth: int | None = None) -> DataFrame:
    """id, met: a dependency is satisfied if it is completed itself or all its leaf descendants are.

    ``edges``: id depends on ``needs``; ``completed``: one column id.
    """
    parents = nodes.where("parent is not null").select(F.col("parent").alias("id")).distinct()
    done = completed.select("id").distinct().withColumn("done", F.lit(True))
    leaves = nodes.select("id", "parent").join(parents, "id", "left_anti").select("id")
    under = ancestors(nodes, depth).join(leaves, "id").join(done, "id", "left").where("distance > 0")
    whole = under.groupBy(F.col("ancestor").alias("id")).agg(F.bool_and(F.coalesce("done", F.lit(False))).alias("all_leaves"))
    state = nodes.select("id").join(done, "id", "left").join(whole, "id", "left").select(F.col("id").alias("needs"), (F.coalesce("done", F.lit(False)) | F.coalesce("all_leaves", F.lit(False))).alias("ok"))
    asked = edges.join(state, "needs", "left").groupBy("id").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("met"))
    return nodes.select("id").join(asked, "id", "left").select("id", F.coalesce("met", F.lit(True)).alias("met"))


def reachable(nodes: DataFrame, edges: DataFrame, completed: DataFrame, depth: int | None = None) -> DataFrame:
    """id, reachable: whether the dependencies of a node and of all its ancestors are met."""
    state = met(nodes, edges, completed, depth).withColumnRenamed("id", "ancestor")
    return ancestors(nodes, depth).join(state, "ancestor").groupBy("id").agg(F.bool_and("met").alias("reachable"))


def next_leaf(nodes: DataFrame, edges: DataFrame, completed: DataFrame, order: list[Column], study: str | None = None, depth: int | None = None) -> DataFrame:
    """id: the first leaf, in the given order, that is reachable and not completed; one row at most."""
    open_ = nodes.join(_leaves(nodes, study), "id").join(completed.select("id"), "id", "left_anti")
    return open_.join(reachable(nodes, edges, completed, depth).where("reachable"), "id").orderBy(*order).limit(1).select("id")


def unlocked(nodes: DataFrame, edges: DataFrame, completed: DataFrame, order: list[Column], study: str | None = None, depth: int | None = None) -> DataFrame:
    """id: completed nodes, the next leaf, and all ancestors of these, each once."""
    seeds = completed.select("id").unionByName(next_leaf(nodes, edges, completed, order, study, depth)).distinct()
    return ancestors(nodes, depth).join(seeds, "id").select(F.col("ancestor").alias("id")).distinct()


def celebrations(nodes: DataFrame, before: DataFrame, after: DataFrame, study: str | None = None, depth: int | None = None) -> DataFrame:
    """stage, total, done: root nodes all of whose leaves are completed after, but were not before."""
    roots = nodes.where("parent is null").select(F.col("id").alias("ancestor"))
    flag = lambda rows, name: rows.select("id").distinct().withColumn(name, F.lit(True))
    under = ancestors(nodes, depth).join(roots, "ancestor").join(_leaves(nodes, study), "id")
    under = under.join(flag(before, "was"), "id", "left").join(flag(after, "now"), "id", "left")
    counts = under.groupBy(F.col("ancestor").alias("stage")).agg(F.count("*").alias("total"), F.count("was").alias("was"), F.count("now").alias("done"))
    return counts.where("was < total and done = total").select("stage", "total", "done")
