"""Exact deduplication as a stateful stream.

Every text is normalised (A-Z lower-cased, null = empty) and digested.  Tasks
first fold equal texts of one Arrow batch into one landed row, so a text that
a third of all rows repeat reaches the shuffle once a batch, not once a row.
The landed rows are the content store.  A streaming aggregation with a
disk-backed state (RocksDB, no expiry) then holds for each digest its largest
document id, its row count and a locator (landed file and row) of its content.
Nothing is called a copy on its digest alone: wherever a digest was hit again,
the full bytes of all landed rows are compared with the content behind the
locator, and should they differ the contents are kept apart.

Defined cases: null or missing text is the empty text; a null id is below all
others; rows repeating an id are copies like any other; an empty table gives
no rows; texts of any length are compared whole; further columns of a stage's
input stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, bounded_batches, fresh, new_path, rows_of, stage

LANDED = "digest binary, text string, ids array<long>, top long, n long"
ENTRY = "digest binary, top long, n long, landed long, holder struct<top: long, file: string, row_at: long>"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold the equal texts of a batch; equal digests with other bytes stay apart."""
    for batch in batches:
        groups: dict[tuple[bytes, str], list] = {}
        for doc_id, text, digest in rows_of(batch, "doc_id", "text", "digest"):
            groups.setdefault((digest, text), []).append(doc_id)
        ids = list(groups.values())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in groups], pa.binary()),
                pa.array([k[1] for k in groups], pa.string()),
                pa.array(ids, pa.list_(pa.int64())),
                pa.array([max((i for i in x if i is not None), default=None) for x in ids], pa.int64()),
                pa.array([len(x) for x in ids], pa.int64()),
            ],
            names=["digest", "text", "ids", "top", "n"],
        )


def fold(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each distinct text of an Arrow batch; works on batch and streaming frames."""
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), ascii_lower(text_col).alias("text"))
    return keyed.withColumn("digest", F.unhex(F.sha2("text", 256))).mapInArrow(_fold, LANDED)


@contextmanager
def _disk_state(spark: SparkSession):
    """RocksDB keeps the state; its files are not allocated ahead, as each partition has several."""
    own = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    }
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def located(rows: DataFrame) -> DataFrame:
    """Landed rows with their locator."""
    return rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_at"))


def keep_stream(landed: DataFrame) -> DataFrame:
    """The state of each digest: largest id, rows, landed rows, and the locator of its content. Never expires."""
    holder = F.max(F.struct("top", "file", "row_at")).alias("holder")
    return located(landed).groupBy("digest").agg(F.max("top").alias("top"), F.sum("n").alias("n"), F.count("*").alias("landed"), holder)


def run_stream(spark: SparkSession, landing: str, entries: str, checkpoint: str) -> None:
    """Drain what has landed since the last call; offsets and state survive a restart.

    Each micro-batch writes the entries that it changed to a folder of its own, so
    that a repeated batch replaces its first attempt.
    """

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{entries}/batch={batch}")

    stream = spark.readStream.schema(LANDED).parquet(landing)
    with _disk_state(spark):
        query = keep_stream(stream).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
        query.awaitTermination()


def land(docs: DataFrame, landing: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Append documents to the landing folder, the content store that locators point into."""
    fold(docs, id_col, text_col).write.mode("append").option("compression", "zstd").parquet(landing)


def decisions(spark: SparkSession, landing: str, entries: str) -> DataFrame:
    """A row for each document that has landed: doc_id, keep_id, group_size, kept, text_sha256."""
    seen = spark.read.schema(ENTRY).parquet(entries)
    # an entry only grows, so its last state is its maximum
    final = stage(seen.groupBy("digest").agg(F.max("top").alias("keep_id"), F.max("n").alias("group_size"), F.max("landed").alias("landed"), F.max("holder").alias("holder")), "final")
    landed = spark.read.schema(LANDED).parquet(landing)
    # a hit counts only if all bytes equal the content behind the locator
    hits = final.where("landed > 1").select("digest", "holder")
    is_held = (F.col("file") == F.col("holder.file")) & (F.col("row_at") == F.col("holder.row_at"))
    texts = located(landed).select("digest", "text", "file", "row_at").join(hits, "digest").groupBy("digest").agg(F.max(F.when(is_held, F.col("text"))).alias("held"), F.min("text").alias("lo"), F.max("text").alias("hi"))
    clash = stage(texts.where("not (lo <=> held and hi <=> held)").select("digest"), "clash")
    columns = ["doc_id", "keep_id", "group_size", "text_sha256"]
    if clash.isEmpty():
        out = landed.select("digest", "ids").join(final, "digest")
    else:
        apart = landed.join(clash, "digest")
        each = apart.groupBy("digest", "text").agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"))
        plain = landed.join(clash, "digest", "left_anti").select("digest", "ids").join(final, "digest").select("digest", "ids", "keep_id", "group_size")
        out = plain.unionByName(apart.join(each, ["digest", "text"]).select("digest", "ids", "keep_id", "group_size"))
    out = out.select(F.explode("ids").alias("doc_id"), "keep_id", "group_size", F.lower(F.hex("digest")).alias("text_sha256")).select(*columns)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Run a whole batch table through the stream and return its decisions."""
    spark = docs.sparkSession
    root = new_path(spark, "exact-dedup")
    land(docs, f"{root}/landing", id_col, text_col)
    run_stream(spark, f"{root}/landing", f"{root}/entries", f"{root}/state")
    return decisions(spark, f"{root}/landing", f"{root}/entries")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each group of equal texts stays, with all its columns."""
    bounded_batches(spark)
    kept = exact_dedup(docs).where("kept").select("doc_id", F.unhex("text_sha256").alias("digest"))
    kept = stage(kept.groupBy("doc_id", "digest").agg(F.count("*").alias("times")), "kept")
    return keep_rows(docs, kept, {"doc_id": F.col("doc_id").cast("long"), "digest": F.unhex(F.sha2(ascii_lower("text"), 256))})


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, T.MapType | T.VariantType | T.CalendarIntervalType)


def keep_rows(docs: DataFrame, kept: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows of ``docs`` whose keys (expressions over ``docs``) are in ``kept``; of rows that repeat all keys (``times`` > 1) one.

    ``kept`` has one row per key.  The columns of ``docs`` stay as they are, whatever their names and types.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    # maps and variants have no order: rows that differ in them alone are ordered by their JSON
    odd = [c for c in docs.columns if not _orderable(docs.schema[c].dataType)]
    one = F.min_by(row, F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in odd), F.to_json(F.struct(*(F.col(f"`{c}`") for c in odd))))) if odd else F.min(row)
    own = dict(zip([*keys, "times", "row"], fresh(docs, *(f"{k}_kept" for k in keys), "times_kept", "row_kept"), strict=True))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    right = kept.select(*(F.col(k).alias(own[k]) for k in keys), F.col("times").alias(own["times"]))
    found = docs.join(right, [e.eqNullSafe(F.col(own[k])) for k, e in keys.items()])
    once = found.where(F.col(own["times"]) == 1).select(*columns)
    again = (
        found.where(F.col(own["times"]) > 1).groupBy(*(own[k] for k in keys))
        .agg(one.alias(own["row"])).select(f"{own['row']}.*")
    )
    return once.unionByName(again)
