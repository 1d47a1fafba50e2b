"""Indexes of a package: its parts with the blocks that hold them, its blocks, and the concepts of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sentences as S
from ..functions import terms as T
from ..functions import text as X
from ..functions.labels import tokens
from .chunking import merge_groups

# The label of a segment without one, and words of risk besides those of trouble.
UNNAMED, RISKS = "字幕", ("注意", "不要", "风险", "安全")


def label_blocks(blocks: DataFrame, package: str) -> DataFrame:
    """package, label, block_ids: the blocks with each label in their order, each once; blank labels are left out."""
    rows = blocks.select(package, "block_id", F.col("order").alias("__at"), F.explode("labels").alias("label")).withColumn("label", X.normalize_whitespace(F.col("label"))).where("label <> ''")
    first = rows.groupBy(package, "label", "block_id").agg(F.min("__at").alias("at"))
    return first.groupBy(package, "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "block_id"))), lambda b: b["block_id"]).alias("block_ids"))


def part_index(segments: DataFrame, blocks: DataFrame, package: str) -> DataFrame:
    """A row for each page and label of a package: its text, times, blocks, points, terms, steps, risks, role, score and noise.

    ``segments``: page (null or 0 for none), label, from, to, text and ``order``; missing times are 0.  ``blocks``: block_id, order and
    labels.  Parts are numbered by their first segment; a part's text is that of one page, which bounds what is joined.
    """
    label = X.normalize_whitespace(F.col("label"))
    rows = segments.withColumns({"page": F.coalesce("page", F.lit(0)), "label": F.when(label == "", UNNAMED).otherwise(label), "text": X.strip(F.col("text"))})
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("order", "text")))), lambda s: s["text"])
    parts = rows.groupBy(package, "page", "label").agg(F.min("order").alias("__first"), texts.alias("__texts"), F.min(F.coalesce("from", F.lit(0.0))).alias("from"), F.max(F.coalesce("to", F.lit(0.0))).alias("to"))
    parts = parts.withColumns({"order": F.row_number().over(Window.partitionBy(package).orderBy("__first", "page", "label")), "text": X.normalize_whitespace(F.array_join("__texts", " "))})
    parts = parts.withColumn("part_id", F.when(F.col("page") > 0, F.format_string("P%02d", "page")).otherwise(F.format_string("part_%03d", "order")))
    parts = parts.join(label_blocks(blocks, package), [package, "label"], "left").withColumn("block_ids", F.coalesce("block_ids", F.array().cast("array<string>")))
    t = F.col("text")
    found = parts.withColumns({
        "summary_points": S.brief_points(t, 6), "terms": T.extract_terms(t, 18), "operation_steps": S.keyword_sentences(t, X.OPERATION, 6), "risk_points": S.keyword_sentences(t, (*X.TROUBLE, *RISKS), 5),
        "role": X.role(t), "noise": X.noise_level(t, t), "noise_reasons": X.noise_reasons(t),
    })
    return found.select(
        package, "part_id", "order", F.nullif("page", F.lit(0)).alias("page"), "label", "block_ids", "from", "to", F.length("text").alias("chars"), F.coalesce(F.get("summary_points", F.lit(0)), "label").alias("topic"), "summary_points",
        "terms", "operation_steps", T.commands(F.col("terms")).alias("commands"), "risk_points", "role", X.scored(F.length("text"), F.col("role"), F.col("noise")).alias("score"), "noise", "noise_reasons", F.left("text", F.lit(900)).alias("excerpt"),
    )


def merge_candidates(parts: DataFrame, package: str, keep: int = 12) -> DataFrame:
    """package, merge_id, part_ids, labels, role, terms: neighbouring parts of a part index worth merging (``chunking.Merges``)."""
    noisy = parts.withColumn("__noisy", F.col("noise") == "high")
    groups = merge_groups(noisy, [package], "order", "role", "terms", "__noisy", keep=keep)
    # positions count all parts, as orders do
    members = groups.select(package, "merge", F.explode(F.sequence("first", "last")).alias("order")).join(parts.select(package, "order", "part_id", "label"), [package, "order"])
    lists = F.array_sort(F.collect_list(F.struct("order", "part_id", "label")))
    named = members.groupBy(package, "merge").agg(lists.alias("__m"))
    out = groups.join(named, [package, "merge"])
    return out.select(package, F.format_string("merge_%03d", "merge").alias("merge_id"), F.transform("__m", lambda m: m["part_id"]).alias("part_ids"), F.transform("__m", lambda m: m["label"]).alias("labels"), "role", "terms")


def source_index(blocks: DataFrame, package: str) -> DataFrame:
    """package, block_id, text_sha1, chars, tokens, key_terms, key_points, excerpt of each block (``block_id, text``)."""
    t = F.coalesce("text", F.lit(""))
    return blocks.select(
        package, "block_id", F.sha1(t).alias("text_sha1"), F.length(t).alias("chars"), X.block_tokens(t).alias("tokens"), T.extract_terms(t, 14).alias("key_terms"), S.brief_points(t, 6).alias("key_points"), F.left(X.normalize_whitespace(t), F.lit(700)).alias("excerpt"))


def concept_index(blocks: DataFrame, package: str, points: int = 10, first: int = 6) -> DataFrame:
    """package, concept, block_ids: the first tokens of each point of each block, with the blocks they are in, sorted."""
    point = F.explode(S.brief_points(F.col("text"), points)).alias("point")
    rows = blocks.select(package, "block_id", point).select(package, "block_id", F.explode(F.slice(tokens(F.col("point")), 1, first)).alias("concept"))
    return rows.distinct().groupBy(package, "concept").agg(F.array_sort(F.collect_list("block_id")).alias("block_ids"))
