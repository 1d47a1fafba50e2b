"""Order-dependent packing: greedy folds over the ordered rows of a group, in bounded memory (``folds``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clock
from ..functions.text import strip
from .folds import running


def greedy_pack(rows: DataFrame, group: list[str], order: str | list[str], size: Column, target: int) -> DataFrame:
    """``rows`` with ``pack`` (from 1): a row opens a new pack if it would take a non-empty one over ``target``.

    Rows of size 0 belong to no pack and are dropped.
    """

    def step(state: tuple[int, int], size: int) -> tuple[tuple[int, int], int]:
        pack, held = state
        full = pack == 0 or held + size > target
        return ((pack + 1, size) if full else (pack, held + size)), pack + full

    sized = rows.withColumn("__size", size.cast("long")).where("__size > 0")
    order = [order] if isinstance(order, str) else order
    return running(sized, group, [*order, "__size"], "__size", lambda: (0, 0), step, "pack").drop("__size")


def pack_entries(entries: DataFrame, group: str | list[str], order: str, text: str, start: str, end: str, target: int) -> DataFrame:
    """Entries packed to ``target`` characters: text, first start and last end of each pack."""
    group = [group] if isinstance(group, str) else group
    trimmed = entries.withColumn("__text", strip(F.col(text)))
    packed = greedy_pack(trimmed, group, order, F.length("__text"), target)
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col("__text").alias("text"))))
    return packed.groupBy(*group, "pack").agg(
        F.regexp_replace(F.array_join(F.transform(parts, lambda p: p["text"]), " "), "[ \t]+", " ").alias("text"),
        F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("entries"),
    )


def two_key_dedup(rows: DataFrame, owner: str, order: str, first: str, second: str, limit: int) -> DataFrame:
    """Per owner, greedy dedup on two keys at once: a row stays if neither key is taken by a row that stayed; ``limit`` rows at most.

    Repeats of one key pair go first, which changes nothing; a fold over an owner's rows then holds at most ``limit`` pairs.
    """
    pairs = rows.groupBy(owner, first, second).agg(F.min(order).alias(order))
    items = pairs.groupBy(owner).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(first).alias("k1"), F.col(second).alias("k2")))).alias("items"))
    kind = "array<struct<at:{},k1:{},k2:{}>>".format(*(dict(rows.dtypes)[c] for c in (order, first, second)))

    def step(kept: Column, x: Column) -> Column:
        taken = F.exists(kept, lambda k: (k["k1"] == x["k1"]) | (k["k2"] == x["k2"])) | (F.size(kept) >= limit)
        return F.when(taken, kept).otherwise(F.concat(kept, F.array(x)))

    kept = items.select(owner, F.explode(F.aggregate("items", F.array().cast(kind), step)).alias("x"))
    return kept.select(owner, F.col("x.at").alias(order), F.col("x.k1").alias(first), F.col("x.k2").alias(second))


def cleaning_chunks(units: DataFrame, group: str, order: str, text: str, label: str, start: str, end: str, target: int = 7000, context: int = 700) -> DataFrame:
    """Units packed to ``target`` characters, rendered with headings and times, each chunk with its neighbours' edges.

    A heading stands before a unit whose label differs from that of the unit before it in the chunk; a unit
    with a start or an end has both before it, a missing one as a question mark.  Empty units are dropped.
    """
    packed = greedy_pack(units.withColumn("__text", strip(F.col(text))), [group], order, F.length("__text"), target)
    unit = Window.partitionBy(group, "pack").orderBy(order)
    name = F.coalesce(label, F.lit(""))
    heading = F.when((name != "") & (name != F.coalesce(F.lag(name).over(unit), F.lit(""))), F.concat(F.lit("\n## "), name, F.lit("\n"))).otherwise("")
    at, to = clock(F.col(start)), clock(F.col(end))
    asked = lambda x: F.when(x == "", "?").otherwise(x)
    times = F.when((at == "") & (to == ""), "").otherwise(F.concat(F.lit("["), asked(at), F.lit("-"), asked(to), F.lit("] ")))
    lines = packed.withColumn("__line", F.struct(F.col(order).alias("at"), name.alias("label"), F.concat(heading, times, "__text").alias("text")))
    chunks = lines.groupBy(group, "pack").agg(F.array_sort(F.collect_list("__line")).alias("__lines"), F.min(start).alias("start"), F.max(end).alias("end"))
    labels = F.array_distinct(F.filter(F.transform("__lines", lambda x: x["label"]), lambda x: x != ""))
    body = strip(F.array_join(F.transform("__lines", lambda x: x["text"]), "\n"))
    w = Window.partitionBy(group).orderBy("chunk")
    chunks = chunks.select(group, F.col("pack").alias("chunk"), body.alias("text"), labels.alias("labels"), "start", "end")
    near = {"previous_tail": F.right(F.lag("text").over(w), F.lit(context)), "next_head": F.left(F.lead("text").over(w), F.lit(context))}
    return chunks.withColumns({k: F.coalesce(v, F.lit("")) for k, v in near.items()})
