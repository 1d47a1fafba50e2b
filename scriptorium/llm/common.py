"""Helpers that several training-data operators share.

Intermediate tables go to the shared folder named by ``spark.checkpoint.dir``;
a local folder is used only where that setting is absent (tests).
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
U64 = np.uint64

#: Bytes that part words, after ASCII lower-casing; bytes of 0x80 and over are parts of words.
NOT_ALNUM = np.array([not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A or b >= 0x80) for b in range(256)])
WHITE = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])
#: The same words as a pattern over lower-cased bytes.
ALNUM_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def ascii_lower(col: Column | str) -> Column:
    """Lower-case A-Z only; null counts as the empty text."""
    col = F.col(col) if isinstance(col, str) else col
    return F.translate(F.coalesce(col, F.lit("")), UPPER, LOWER)


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate data, as a URI or path."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(base)
    return str(base).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def drop(*staged: DataFrame) -> None:
    """Delete what ``stage`` wrote for tables that nothing reads any more."""
    for df in staged:
        drop_path(df.sparkSession, df.staged_at)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete an intermediate folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to differ from all columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; the caller may pass any other path instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Python tuples of the named columns."""
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


COUNTS = "chunk int, counts binary"
CHUNKS = 64


def packed_counts(total: np.ndarray) -> tuple[list[int], list[bytes]]:
    """A task's counts as ``CHUNKS`` compressed pieces, without empty ones."""
    per = -(-len(total) // CHUNKS)
    parts = [(c, total[c * per : (c + 1) * per]) for c in range(CHUNKS)]
    parts = [(c, zlib.compress(x.astype(np.int64).tobytes(), 1)) for c, x in parts if x.any()]
    return [c for c, _ in parts], [x for _, x in parts]


def summed_counts(pieces: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' counts (``COUNTS``): pieces are added in Spark, the driver gets one table of ``size`` numbers."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, x in rows_of(batch, "chunk", "counts"):
                sums[c] = sums.get(c, 0) + np.frombuffer(zlib.decompress(x), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], names=["chunk", "counts"])

    per, out = -(-size // CHUNKS), np.zeros(size, np.int64)
    for row in pieces.repartition(CHUNKS, "chunk").mapInArrow(add, COUNTS).collect():  # of a fixed size
        out[row.chunk * per : (row.chunk + 1) * per] += np.frombuffer(zlib.decompress(row.counts), np.int64)
    return out


def bounded_batches(spark: SparkSession, rows: int = 2000, mb: int = 8) -> None:
    """Hand Python at most so many rows and MB at once: documents can be long and workers have little memory.

    Plans read these settings when they run, so they stay set in the session; smaller ones are left alone.
    """
    key, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)
    now = re.fullmatch(r"(\d+)([bkmg]?)b?", spark.conf.get(size).lower())
    if not now or not 0 < int(now[1]) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}[now[2]] <= mb << 20:
        spark.conf.set(size, f"{mb}m")


def release_memory() -> None:
    """Give memory that earlier tasks of this worker freed back to the system: several workers and a JVM share an executor's limit."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with well mixed bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Polynomials modulo 2**64 tell no alternating words of some 1,000 letters apart; longer words than this take a cryptographic hash.
LONG_WORD = 128
_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], U64) + U64(0xA5A5))
_powers = [np.ones(1, U64), np.ones(1, U64)]


def _grown(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[i] = np.cumprod(np.concatenate([np.ones(1, U64), np.full(n + (1 << 16), base, U64)]))
    return _powers


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data, offsets


def hashed_words(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray, upto: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Words of texts without a Python object each, some texts at a time.

    Yields first text, last text + 1, the place of each text's first word (and the end),
    and of each word the start, end and a 64-bit hash that ignores the case of A-Z.
    """
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + upto, "right")) - 1)
        at, end = int(offsets[first]), int(offsets[last])
        b = data[at:end]
        word = np.concatenate([[False], ~parts[b], [False]])
        starts_text = np.zeros(len(b) + 1, bool)
        starts_text[offsets[first : last + 1] - at] = True
        begins = np.flatnonzero(word[1:-1] & (~word[:-2] | starts_text[:-1]))
        ends = np.flatnonzero(word[1:-1] & (~word[2:] | starts_text[1:])) + 1
        up, down = _grown(len(b) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, U64), np.cumsum(_BYTE[b] * up[: len(b)])])
            h = mix((total[ends] - total[begins]) * down[begins])
        for i in np.flatnonzero(ends - begins > LONG_WORD).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(b[begins[i] : ends[i]].tobytes().lower(), digest_size=8).digest(), "little")
        places = np.searchsorted(begins, offsets[first : last + 1] - at)
        yield first, last, places, begins + at, ends + at, h
        first = last
