"""JSON documents, JSON lines and progress lines, read without failing on broken ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

PROGRESS = r"^__[A-Z]+_DISTILL_PROGRESS__=(\{.*\})\r?$"  # fixed format: prefix-tagged JSON
EVENT = "message string, percent double, stage string, cacheHint string, audioCompleted double, audioTotal double, chunkCompleted double, chunkTotal double, resumed boolean"


def parsed(value: Column) -> Column:
    """The value as a variant; null where it is no JSON."""
    return F.try_parse_json(value)


def is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(parsed(value)), F.lit("OBJECT")), F.lit(False))


def read_objects(spark: SparkSession, path: str, schema: str | DataType) -> DataFrame:
    """file and ``document`` of each JSON file; null unless it holds an object."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return files.select("file", F.when(is_object(F.col("value")), F.from_json("value", schema)).alias("document"))


def lines_summary(lines: DataFrame, value: str, ids: list[str], group: list[str] | None = None) -> DataFrame:
    """Lines (broken ones too), broken lines, and distinct non-empty values of each key of ``ids``; blank lines do not count."""
    rows = lines.where(F.trim(value) != "")
    counts = [F.count_distinct(F.nullif(F.trim(F.get_json_object(value, f"$.{c}")), F.lit(""))).alias(f"{c}s") for c in ids]
    return rows.groupBy(*(group or [])).agg(F.count("*").alias("lines"), F.count_if(parsed(F.col(value)).isNull()).alias("broken"), *counts)


def registry_rows(documents: DataFrame, value: str, entry: str) -> DataFrame:
    """up_id, last_sync, key and ``entry`` of each video of registry documents; a document without a map has no rows."""
    kind = f"up_id string, last_sync string, videos map<string, struct<{entry}>>"
    doc = documents.select(F.from_json(value, kind).alias("d"))
    return doc.select("d.up_id", "d.last_sync", F.explode("d.videos").alias("key", "entry")).where("entry is not null")


def progress_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Events of prefix-tagged lines, batch or stream; others and malformed ones are left out."""
    body = F.regexp_extract(value, PROGRESS, 1)
    events = lines.where(F.col(value).rlike(PROGRESS) & parsed(body).isNotNull()).select(F.from_json(body, EVENT).alias("e")).select("e.*")
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("percent", "audioCompleted", "audioTotal", "chunkCompleted", "chunkTotal") if c in events.columns}
    return events.withColumns(zero | {"resumed": F.coalesce("resumed", F.lit(False)), "stage": F.coalesce(F.nullif(F.trim("stage"), F.lit("")), F.lit("unknown"))})


def write_lines(rows: DataFrame, path: str) -> None:
    """One compact JSON object a line."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_texts(rows: DataFrame, text: str, path: str) -> None:
    """Texts without trailing white space, each ended by a line feed."""
    rows.select(F.regexp_replace(text, r"\s+$", "").alias("value")).write.mode("overwrite").text(path)
