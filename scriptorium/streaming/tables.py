"""Streams into keyed tables: state lives in Spark's checkpoints and in the tables written.

Every stream runs over what has arrived (``availableNow``) and resumes from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def arrived(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files: int = 16) -> DataFrame:
    """A stream over the Parquet files of a folder, some files a batch."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)


def run(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run to the end of what has arrived; ``write`` may see a batch twice after a failure."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def first_seen(stream: DataFrame, key: str) -> DataFrame:
    """Keys that no earlier batch had; the set of known keys never expires."""
    return stream.select(key).dropDuplicates([key])


def windows(stream: DataFrame, at: str, width: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Counts per window and keys; ``late`` bounds the state by a watermark."""
    stream = stream.withWatermark(at, late) if late else stream
    return stream.groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def to_versions(path: str) -> Callable[[DataFrame, int], None]:
    """Write each batch to a folder of its own: a repeated batch replaces itself."""
    return lambda batch, k: batch.write.mode("overwrite").parquet(f"{path}/batch={k}")


def newest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The row of each key from the last batch that held it."""
    rows = spark.read.option("basePath", path).parquet(path)
    values: list[Column] = [F.col(c) for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")
