"""Folders of materials: packages two levels below a root, sizes, lengths of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The file a package must hold, and those of which it must hold one.
REQUIRED = "manifest.json"
ANY_OF = ("raw_transcript.txt", "exports/notebooklm.md", "library_refs.json", "run_state.json")


def files(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to the root) and size of every file below ``root``; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split(":", 1)[-1].replace("///", "/").rstrip("/") + "/"
    at = F.url_decode(F.regexp_replace("path", "^[a-z]+:/*", "/"))
    return listed.select(F.substring(at, F.lit(len(base) + 1), F.length(at)).alias("path"), F.col("length").alias("size"))


def packages(listed: DataFrame) -> DataFrame:
    """creator and item of each folder exactly two levels down that is a package."""
    parts = F.split("path", "/")
    inside = F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), "/")
    deep = listed.where(F.size(parts) > 2).select(parts[0].alias("creator"), parts[1].alias("item"), inside.alias("inside"))
    held = deep.groupBy("creator", "item").agg(F.bool_or(F.col("inside") == REQUIRED).alias("required"), F.bool_or(F.col("inside").isin(*ANY_OF)).alias("other"))
    return held.where("required and other").select("creator", "item")


def sizes(listed: DataFrame, depth: int = 1) -> DataFrame:
    """Bytes and files below each folder of that depth, whatever lies how deep."""
    parts = F.split("path", "/")
    return listed.where(F.size(parts) > depth).groupBy(F.array_join(F.slice(parts, 1, depth), "/").alias("folder")).agg(F.sum("size").alias("bytes"), F.count("*").alias("files"))


def text_lengths(spark: SparkSession, path: str) -> DataFrame:
    """file and length of its text without white space around it."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.length(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("chars"))
