"""Sums over JSON of any depth, as variants unfolded a level at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.places import stage

# The names of token counts; of two the first one present counts, whatever it holds.
INPUT, OUTPUT, TOTAL = ("prompt_tokens", "input_tokens"), ("completion_tokens", "output_tokens"), ("total_tokens",)


def whole_number(value: Column) -> Column:
    """A number without its fraction, true as 1; null for anything else."""
    kind = F.schema_of_variant(value)
    number = F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("long")).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, "$", "double").try_cast("long"))
    return F.when(kind == "BIGINT", F.try_variant_get(value, "$", "long")).otherwise(number)


def containers(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``key, value``: the objects and arrays within the variants, at any depth, themselves included.

    Each level is a table in the shared folder made of what the level before holds; the last one is empty.
    """
    inner = lambda c: F.schema_of_variant(c).rlike("^(OBJECT|ARRAY)")
    level = stage(rows.select(key, F.col(value).alias("value")).where(inner(F.col("value"))), "level")
    out = level
    while not level.isEmpty():
        children = level.alias("l").lateralJoin(level.sparkSession.tvf.variant_explode(F.col("l.value").outer()).select(F.col("value").alias("child")))
        level = stage(children.where(inner(F.col("child"))).select(key, F.col("child").alias("value")), "level")
        out = out.unionByName(level)
    return out


def usage_tokens(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, input_tokens, output_tokens, total_tokens: sums over all objects of a row's variant, at any depth.

    Where an object has both names of a count, the first one counts.  A total is that of input and output only where no
    total (or none but zeros) was seen in the whole row.  Rows without any object have zeros.
    """
    found = containers(rows, key, value).where(F.schema_of_variant("value").startswith("OBJECT"))

    def count(names: tuple[str, ...]) -> Column:
        return F.coalesce(whole_number(F.coalesce(*(F.try_variant_get("value", f"$.{n}", "variant") for n in names))), F.lit(0))

    parts = found.select(key, count(INPUT).alias("i"), count(OUTPUT).alias("o"), count(TOTAL).alias("t"))
    sums = parts.groupBy(key).agg(F.sum("i").alias("i"), F.sum("o").alias("o"), F.sum("t").alias("t"))
    all_ = rows.select(key).distinct().join(sums, key, "left").na.fill(0, ["i", "o", "t"])
    return all_.select(key, F.col("i").alias("input_tokens"), F.col("o").alias("output_tokens"), F.when(F.col("t") != 0, F.col("t")).otherwise(F.col("i") + F.col("o")).alias("total_tokens"))
