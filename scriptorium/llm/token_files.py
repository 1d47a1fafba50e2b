"""Token files: ids under a canonical, length-limited Huffman code.

1. Documents are encoded; each ends with the id 0.  The ids are staged packed,
   with each task's counts of them, whose sums are those of the whole corpus.
2. Package-merge gives the code lengths (at most ``LIMIT`` bits), from which the
   canonical code follows; the table has the size of the vocabulary.
3. Packed ids are dealt by ranges of doc_id (dealing samples its input, which so is
   a plain scan); each task codes its documents, each on a byte boundary, and writes
   one file.
4. A file is a header with the code lengths and a row of blocks that can be read
   alone.  A block lists its documents and, for each, the bit offset of every
   ``STEP``-th token.  A reader decodes from all these offsets at once with one
   table lookup a token.

Files carry a name of their own for each attempt; only those that the committed
index names count, so a lost executor leaves no doubt.

Defined cases: null text is empty and has the single id 0; a null doc_id sorts
first; rows that repeat an id stand beside each other, ordered by their tokens;
an empty table gives no files and no rows; further columns take no part; texts
of any length are one document.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, packed_counts, rows_of, stage, summed_counts, tokenizer_path
from .pieces import byte_encoder

MAGIC = b"HUFTOK01"
LIMIT, STEP, BLOCK_TOKENS, END = 16, 1024, 1 << 16, 0
#: Blocks that a reader decodes side by side.
TOGETHER = 24
DOC = "<?qIII"  # has an id, id, tokens, bytes of bits, offsets


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that never occur."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    limit = max(limit, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, flags = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        level = both[by]
        flags.append(by < len(leaves))
    depth, need = np.zeros(len(leaves), np.int64), 2 * len(leaves) - 2
    for is_leaf in reversed(flags):
        k = int(is_leaf[:need].sum())
        depth[:k] += 1
        need = 2 * (need - k)
    out[order] = depth
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes by id, and the ids in code order."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    size = lengths[order].astype(int)
    starts = np.zeros(len(order), np.int64)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        code <<= n - last
        starts[at] = code + np.arange(len(at))
        code, last = code + len(at), n
    codes[order] = starts
    return codes, order


class Code:
    """Both directions of a canonical code."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.lengths = lengths
        self.codes, order = canonical(lengths)
        self.width = int(lengths.max(initial=1))
        size = lengths[order].astype(np.int64)
        self.table = np.repeat(order.astype(np.uint32), 1 << (self.width - size))
        self.sizes = np.repeat(size, 1 << (self.width - size))

    def encode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits of several documents (``ends``: of their ids), each from a byte on.

        Returns the bytes, the byte where each document begins (and the end), and the bit of each id.
        """
        size = self.lengths[ids].astype(np.int64)
        bit = np.concatenate([[0], np.cumsum(size)])
        first = np.concatenate([[0], ends[:-1]])
        n_bytes = (bit[ends] - bit[first] + 7) // 8
        starts = np.concatenate([[0], np.cumsum(n_bytes)])
        at = bit[:-1] + np.repeat(starts[:-1] * 8 - bit[first], ends - first)
        # a code of up to 17 bits touches two words of 16, a longer one three
        reach = 2 if self.width <= 17 else 3
        wide = self.codes[ids].astype(np.int64) << (16 * reach - size - (at & 15))
        words = sum(np.bincount((at >> 4) + i, (wide >> 16 * (reach - 1 - i)) & 0xFFFF, int(starts[-1] // 2 + reach)) for i in range(reach))
        return words.astype(">u2").view(np.uint8), starts, at

    def decode(self, data: np.ndarray, bits: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """``counts`` ids from each bit offset, one after the other."""
        order = np.argsort(-counts, kind="stable")
        out = np.empty(int(counts.sum()), np.uint32)
        to = (np.cumsum(counts) - counts)[order]
        at, left = bits[order].astype(np.int64), counts[order]
        data = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
        wide = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        active = len(at)
        for i in range(int(left[0]) if active else 0):
            active = int(np.searchsorted(-left, -i, "left"))  # lanes with more than i ids
            p = at[:active]
            look = ((wide[p >> 3] << (p & 7).astype(np.uint32)) >> np.uint32(32 - self.width)).astype(np.int64)
            out[to[:active] + i] = self.table[look]
            at[:active] += self.sizes[look]
        return out


ENCODED = "doc_id long, tie long, ids binary, chunk int, counts binary"


def _encode(path: str, dtype: str, vocabulary: int):
    """doc_id, text -> the ids of each document and a number that orders rows of equal doc_id; and this task's counts."""

    def run(batches):
        encode, total, end = byte_encoder(path), np.zeros(vocabulary, np.int64), np.array([END], dtype).tobytes()
        names, kinds = [f.split()[0] for f in ENCODED.split(", ")], [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
        for batch in batches:
            found = list(encode.arrays(batch.column("text").to_pylist()))
            if found:
                total += np.bincount(np.concatenate(found), minlength=vocabulary)
                total[END] += len(found)
            ids = [x.tobytes() + end for x in found]
            columns = [batch.column("doc_id"), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(ids), k) for k in kinds[3:])], names=names)
        chunks, counts = packed_counts(total)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(chunks), k) for k in kinds[:3]), pa.array(chunks, kinds[3]), pa.array(counts, kinds[4])], names=names)

    return run


def _coded(code: Code, dtype: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """doc_id, tokens, bits and bit offsets of each document, coded some documents at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            rows = batch.slice(at, 512)
            packed = rows.column("ids").to_pylist()
            ends = np.cumsum([len(x) // np.dtype(dtype).itemsize for x in packed])
            data, starts, bit = code.encode(np.frombuffer(b"".join(packed), dtype), ends)
            first = 0
            for doc_id, end, a, b in zip(rows.column("doc_id").to_pylist(), ends.tolist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                yield doc_id, end - first, data[a:b].tobytes(), (bit[first:end:STEP] - a * 8).astype("<u4").tobytes()
                first = end


INDEX = "part int, file string, block int, offset long, size long, docs long, tokens long"


def _write(root: str, lengths, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        part, out, offset, block = TaskContext.get().partitionId(), None, 0, 0
        heads, bodies, tokens, index = [], [], 0, []

        def flush():
            nonlocal offset, block, heads, bodies, tokens
            raw = struct.pack("<I", len(heads)) + b"".join(heads) + b"".join(bodies)
            out.write(raw)
            index.append((part, name, block, offset, len(raw), len(heads), tokens))
            offset, block, heads, bodies, tokens = offset + len(raw), block + 1, [], [], 0

        for doc_id, n, bits, marks in _coded(Code(lengths.value), dtype, batches):
            if out is None:
                fs, base = pafs.FileSystem.from_uri(root)
                fs.create_dir(base, recursive=True)
                name = f"tokens-{part:06d}-{uuid.uuid4().hex}.huf"
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
                table = zlib.compress(lengths.value.tobytes())
                offset = out.write(MAGIC + struct.pack("<I", len(table)) + table)
            heads.append(struct.pack(DOC, doc_id is not None, doc_id or 0, n, len(bits), len(marks) // 4) + marks)
            bodies.append(bits)
            tokens += n
            if tokens >= BLOCK_TOKENS:
                flush()
        if out is not None:
            if heads:
                flush()
            out.close()
        names = [f.split()[0] for f in INDEX.split(", ")]
        types = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*index, strict=True)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def write(docs: DataFrame, root: str, tokenizer: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` in ascending doc_id order; returns the index of blocks."""
    spark, path = docs.sparkSession, tokenizer or tokenizer_path("byte_bpe_50k.json")
    vocabulary, dtype = byte_encoder(path).vocabulary, byte_encoder(path).dtype
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    staged = stage(rows.mapInArrow(_encode(path, dtype, vocabulary), ENCODED), "ids")
    counts = summed_counts(staged.where("chunk is not null").select("chunk", "counts"), vocabulary)
    lengths = spark.sparkContext.broadcast(code_lengths(counts))  # a byte for each id of the vocabulary
    coded = staged.where("chunk is null").select("doc_id", "tie", "ids")
    dealt = coded.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return stage(dealt.mapInArrow(_write(root, lengths, dtype), INDEX), "token-index")


def _read(root: str):
    def run(batches):
        from pyarrow import fs as pafs

        fs, base = pafs.FileSystem.from_uri(root)
        codes: dict[bytes, Code] = {}
        for batch in batches:
            rows = list(rows_of(batch, "file", "offset", "size", "start"))
            for at in range(0, len(rows), TOGETHER):
                some = rows[at : at + TOGETHER]
                for name in dict.fromkeys(r[0] for r in some):
                    with fs.open_input_file(f"{base}/{name}") as src:
                        head = src.read(12)
                        table = src.read(struct.unpack("<I", head[8:])[0])
                        if table not in codes:  # files written together share it
                            codes = {table: Code(np.frombuffer(zlib.decompress(table), np.uint8))}
                        raws = []
                        for _, offset, size, start in (r for r in some if r[0] == name):
                            src.seek(offset)
                            raws.append((src.read(size), start))
                    yield decoded(codes[table], raws)

    return run


def decoded(code: Code, blocks: list[tuple[bytes, int]]) -> pa.RecordBatch:
    """Documents of some blocks (bytes, first token): all their bit offsets are decoded side by side."""
    heads, marks, bodies, begins, starts, before = [], [], [], [], [], 0
    for raw, start in blocks:
        at, n = 4, struct.unpack_from("<I", raw)[0]
        for _ in range(n):
            head = struct.unpack_from(DOC, raw, at)
            at += struct.calcsize(DOC)
            marks.append(np.frombuffer(raw, "<u4", head[4], at).astype(np.int64) + before * 8)
            at += 4 * head[4]
            heads.append(head)
            starts.append(start)
            start, before = start + head[2], before + head[3]
        bodies.append(raw[at:])
    tokens = np.array([h[2] for h in heads], np.int64)
    lanes = np.full(sum(map(len, marks)), STEP, np.int64)
    lanes[np.cumsum([len(m) for m in marks]) - 1] = (tokens - 1) % STEP + 1
    words = code.decode(np.frombuffer(b"".join(bodies), np.uint8), np.concatenate(marks), lanes).astype("<u4").view(np.uint8)
    ends = np.cumsum(tokens)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([h[1] if h[0] else None for h in heads], pa.int64()),
            pa.array(starts, pa.int64()),
            pa.array(tokens),
            pa.array([words[4 * a : 4 * b].tobytes() for a, b in zip(ends - tokens, ends, strict=True)], pa.binary()),
        ],
        names=["doc_id", "start", "n_tokens", "ids"],
    )


def read(spark: SparkSession, index: DataFrame, root: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (packed little-endian 32 bits) of every document, from the files."""
    files = index.groupBy("part").agg(F.sum("tokens").alias("t"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("part", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("base"))  # a row a file
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = index.join(bases, "part").withColumn("start", F.col("base") + F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    # neighbouring blocks of a file go to one task, to be decoded side by side
    dealt = blocks.select("file", "offset", "size", "start").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", "offset")
    return dealt.mapInArrow(_read(root), "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the files, read them back and digest what was read."""
    root = new_path(docs.sparkSession, "token-files")
    index = write(docs, root, tokenizer)
    return read(docs.sparkSession, index, root).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
