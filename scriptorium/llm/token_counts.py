"""Exact token counts from a histogram of encoded lengths.

Tasks encode whole texts and hand on one count per length; everything else is
answered from the histogram: totals and quantiles from running sums, and the
total under any context limit L as (tokens of documents no longer than L) plus
L times (documents longer than L).  Running sums are taken in two levels, over
blocks of lengths and within a block, so no task sees all lengths.

Defined cases: null text is empty and counts as length 0; repeated rows count
each time; an empty table has an empty histogram and totals of 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, tokenizer_path
from .pieces import byte_encoder

BLOCK = 1024


def _lengths(path: str):
    def run(batches):
        encode = byte_encoder(path)
        for batch in batches:
            n, docs = np.unique(encode.lengths(batch.column(0).to_pylist()), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["n_tokens", "docs"])

    return run


def histogram(docs: DataFrame, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """n_tokens, docs: how many documents have each encoded length."""
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    return docs.select(text).mapInArrow(_lengths(path), "n_tokens long, docs long").groupBy("n_tokens").agg(F.sum("docs").alias("docs"))


def with_totals(lengths: DataFrame) -> DataFrame:
    """The histogram with its running sums.

    For each length L that occurs: documents and tokens up to and over L, the share of
    documents up to L (L is the quantile of that rank), and the total of the corpus when
    every document is cut to L tokens.
    """
    rows = stage(lengths.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)), "lengths")
    sums = rows.groupBy("block").agg(F.sum("docs").alias("d"), F.sum(F.col("docs") * F.col("n_tokens")).alias("t"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    bases = sums.select(
        "block",
        F.coalesce(F.sum("d").over(before), zero).alias("d_before"), F.coalesce(F.sum("t").over(before), zero).alias("t_before"),
        F.coalesce(F.sum("d").over(after), zero).alias("d_after"), F.coalesce(F.sum("t").over(after), zero).alias("t_after"),
    )
    up = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(1, Window.unboundedFollowing)
    tokens = F.col("docs") * F.col("n_tokens")
    out = rows.join(bases, "block").select(
        "n_tokens", "docs",
        (F.col("d_before") + F.sum("docs").over(up)).alias("docs_up_to"),
        (F.col("t_before") + F.sum(tokens).over(up)).alias("tokens_up_to"),
        (F.col("d_after") + F.coalesce(F.sum("docs").over(over), zero)).alias("docs_over"),
        (F.col("t_after") + F.coalesce(F.sum(tokens).over(over), zero)).alias("tokens_over"),
    )
    return out.withColumn("share_up_to", F.col("docs_up_to") / (F.col("docs_up_to") + F.col("docs_over"))).withColumn(
        "truncated_total", F.col("tokens_up_to") + F.col("n_tokens") * F.col("docs_over")
    )


def truncated_totals(lengths: DataFrame, limits: list[int]) -> DataFrame:
    """limit, total: tokens of the corpus with every document cut to the limit, for any limits."""
    sums = lengths.agg(*(F.coalesce(F.sum(F.least("n_tokens", F.lit(x)) * F.col("docs")), F.lit(0)).cast("long").alias(str(x)) for x in limits))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(x).cast("long").alias("limit"), F.col(str(x)).alias("total")) for x in limits))).alias("r")).select("r.*")


def quantile(totals: DataFrame, q: float) -> DataFrame:
    """The least length that at least a share ``q`` of documents does not exceed."""
    return totals.where(F.col("share_up_to") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    return with_totals(histogram(docs, text, tokenizer))
