"""Courses as trees of nodes: pre-order with pruned subtrees, and children put into the order of teaching.

Nodes are rows ``course, id, parent, kind, title, summary, rank``; roots have no parent, ``rank`` orders siblings
(ties by id).  Each node gets a key that sorts its course in pre-order: the key of its parent and its own place among
its siblings, made a level at a time.  A subtree is then a range of keys, so pruning is one running pass over the
sorted keys and no join a level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import let
from ..sources.places import stage
from .folds import running

# Titles of recap nodes, and keywords of the buckets of a lesson in their order.
RECAP_PARTS, RECAP_WHOLE = ("阶段复盘", "阶段练习"), ("复盘", "练习", "回顾")
BUCKETS = {
    0: ("导学", "导论", "入门", "起步", "概览", "总览", "先导", "认识", "基础"), 1: ("概念", "定义", "原理", "本质", "规则", "特点", "核心", "理解"), 2: ("例子", "示例", "案例", "演示", "场景", "体验"),
    3: ("操作", "实战", "练习", "使用", "流程", "步骤", "方法", "配置", "上手", "技巧"), 4: ("易错", "错误", "误区", "陷阱", "注意", "禁忌", "风险"), 5: ("复盘", "回顾", "总结", "练习", "测验", "自检", "检查"),
}
DIGITS = 10


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def is_recap(title: Column) -> Column:
    return let(F.lower(plain(title)), lambda t: F.greatest(*(F.contains(t, F.lit(p)) for p in RECAP_PARTS)) | t.isin(*RECAP_WHOLE))


def teaching_bucket(title: Column, summary: Column) -> Column:
    """The first bucket with a keyword in title or summary; that of practice without any."""
    text = F.lower(F.concat_ws(" ", F.nullif(plain(title), F.lit("")), F.nullif(plain(summary), F.lit(""))))

    def found(t: Column) -> Column:
        out = F.lit(3)
        for bucket, words in reversed(BUCKETS.items()):
            out = F.when(F.greatest(*(F.contains(t, F.lit(w)) for w in words)), bucket).otherwise(out)
        return out

    return let(text, found)


def keyed(nodes: DataFrame, most: int = 64) -> DataFrame:
    """``nodes`` with ``key`` (sorts a course in pre-order) and ``depth``; nodes that hang on no root have none and are dropped.

    Levels are joined one at a time, each row in the level it belongs to; ``most`` ends what a cycle never would.
    """
    place = F.row_number().over(Window.partitionBy("course", "parent").orderBy("rank", "id"))
    rows = stage(nodes.withColumn("step", F.lpad(place.cast("string"), DIGITS, "0")), "nodes")
    level = rows.where("parent is null").withColumn("key", F.col("step")).withColumn("depth", F.lit(0))
    out = level
    for _ in range(most):
        up = level.select("course", F.col("id").alias("parent"), F.col("key").alias("__key"), (F.col("depth") + 1).alias("depth"))
        level = stage(rows.join(up, ["course", "parent"]).withColumn("key", F.concat("__key", "step")).select(*rows.columns, "key", "depth"), "level")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.drop("step")


def pruned(keyed_: DataFrame, drop: Column) -> DataFrame:
    """Without the subtrees of nodes for which ``drop`` holds: one pass over the keys of a course, which holds the open key."""

    def step(open_: str, marked: str) -> tuple[str, int]:
        key = marked[1:]
        if open_ and key.startswith(open_):
            return open_, 0
        return (key, 0) if marked[0] == "1" else ("", 1)

    marked = keyed_.withColumn("__marked", F.concat(F.when(drop, "1").otherwise("0"), "key"))
    return running(marked, ["course"], ["key"], "__marked", lambda: "", step, "__kept").where("__kept = 1").drop("__marked", "__kept")


def flattened(nodes: DataFrame) -> DataFrame:
    """course, position, id, parent, depth, children: the pre-order of each course without recap nodes and what is below them.

    Positions start at 1; ``children`` are the ids of a node's children in their order, none for a leaf.
    """
    kept = stage(pruned(keyed(nodes), is_recap(F.col("title"))), "kept")
    below = kept.where("parent is not null").groupBy("course", F.col("parent").alias("id")).agg(F.array_sort(F.collect_list(F.struct("key", "id"))).alias("c"))
    position = F.row_number().over(Window.partitionBy("course").orderBy("key"))
    rows = kept.select("course", position.alias("position"), "id", "parent", "depth").join(below, ["course", "id"], "left")
    children = F.coalesce(F.transform("c", lambda x: x["id"]), F.array().cast("array<string>"))
    return rows.select("course", "position", "id", "parent", "depth", children.alias("children"))


def restructured(nodes: DataFrame, needs: DataFrame, most: int = 8) -> DataFrame:
    """course, id, parent, rank, needs: children in the order of teaching, linked one after the other.

    Children that are all lessons are ordered by bucket, then rank; others keep their order.  Recap nodes right below a
    root go, with all below them.  Children are numbered from 1; each needs what it needed outside of its siblings and
    the sibling before it, ``most`` at most, ids that differ by case only once.  ``needs`` has ``course, id, needs, at``, where
    ``at`` is the place of an entry.  A parent's order never depends on that of its children, so all levels are done at once.
    """
    tree = keyed(nodes)
    kept = stage(pruned(tree, (F.col("depth") == 1) & is_recap(F.col("title"))), "kept")
    siblings = Window.partitionBy("course", "parent")
    # whether all are lessons is asked before recap nodes go
    lessons = tree.groupBy("course", "parent").agg(F.bool_and(F.coalesce(F.col("kind") == "lesson", F.lit(False))).alias("lessons"))
    rows = kept.join(lessons.where("parent is not null"), ["course", "parent"], "left")
    rows = rows.withColumn("__bucket", F.when(F.col("lessons"), teaching_bucket(F.col("title"), F.col("summary"))).otherwise(0))
    order = siblings.orderBy("__bucket", "key")
    ranked = rows.select("course", "id", "parent", F.when(F.col("parent").isNull(), F.col("rank")).otherwise(F.row_number().over(order)).cast("long").alias("rank"), F.when(F.col("parent").isNotNull(), F.lag("id").over(order)).alias("before"))
    ranked = stage(ranked, "ranked")
    family = ranked.select("course", F.col("id").alias("needs"), F.col("parent").alias("__of"))
    own = needs.join(ranked.select("course", "id", "parent"), ["course", "id"]).join(family, ["course", "needs"], "left")
    outside = own.where("parent is null or not (needs <=> id or coalesce(__of = parent, false))").where("needs <> ''").select("course", "id", "needs", "at")
    linked = outside.unionByName(ranked.where("before is not null").select("course", "id", F.col("before").alias("needs"), F.lit(2**62).alias("at")))
    first = linked.groupBy("course", "id", F.lower("needs").alias("__low")).agg(F.min(F.struct("at", "needs")).alias("n"))
    nth = F.row_number().over(Window.partitionBy("course", "id").orderBy("n"))
    lists = first.withColumn("__n", nth).where(F.col("__n") <= most).groupBy("course", "id").agg(F.transform(F.array_sort(F.collect_list("n")), lambda x: x["needs"]).alias("needs"))
    return ranked.join(lists, ["course", "id"], "left").select("course", "id", "parent", "rank", F.coalesce("needs", F.array().cast("array<string>")).alias("needs"))
