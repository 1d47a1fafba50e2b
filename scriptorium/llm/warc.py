"""WARC archives: write, index, and read selected records by coalesced byte ranges.

Payload digests are taken first; of equal payloads of ``REVISIT_BYTES`` or more
the record with the largest id is the response and the others revisit it.
Payloads are equal if their SHA-256 is; records carry the SHA-1 that the format
asks for as a field.
Tasks write gzip members, one record each, to files with a name of their own
for each attempt, and return the index: file, offset, length, URL, digest.
Only files that the committed index names count.  A reader sorts the chosen
index rows by file and offset, joins neighbouring ranges into one read, and
parses and checks each record.

Defined cases: null payload is empty, null URL is empty; a null id is below
all others; rows that repeat id and payload are records of their own; an empty
table writes no file; line breaks in URLs become spaces, in records and index;
payloads of any length are one record; further columns take no part.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, rows_of, stage

REVISIT_BYTES = 1000
FILE_BYTES, READ_BYTES, GAP_BYTES = 256 << 20, 8 << 20, 64 << 10
INDEX = "page_id long, file string, offset long, length long, url string, digest string"


def payloads(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), "[\r\n]", " ").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))


def targets(rows: DataFrame) -> DataFrame:
    """content (SHA-256) and target (largest id) of payloads that occur more than once and are large enough."""
    sized = rows.where(F.octet_length("html") >= REVISIT_BYTES).select("page_id", F.unhex(F.sha2("html", 256)).alias("content"))
    found = sized.groupBy("content").agg(F.max("page_id").alias("target"), F.count("*").alias("times"))
    # written, so that the join has an exchange on both sides and a hot digest can be split
    return stage(found.where("times > 1").select("content", "target"), "warc-targets")


def record(page_id: int | None, url: str, payload: bytes, digest: str, target: int | None, has_target: bool) -> bytes:
    """One gzip member with one record."""
    name = base64.b32encode(bytes.fromhex(digest)).decode()
    head = [
        "WARC/1.0", f"WARC-Type: {'revisit' if has_target else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{name}", f"X-Payload-Length: {len(payload)}",
    ]
    if has_target:
        head += [f"WARC-Refers-To: <urn:page:{target}>", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    packer = zlib.compressobj(1, wbits=31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n") + packer.flush()


def _write(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        part, out, at, name = TaskContext.get().partitionId(), None, 0, ""
        for batch in batches:
            index = []
            for page_id, url, html, digest, target, again in rows_of(batch, "page_id", "url", "html", "digest", "target", "again"):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    fs, base = pafs.FileSystem.from_uri(root)
                    fs.create_dir(base, recursive=True)
                    name, at = f"pages-{part:06d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                raw = record(page_id, url, html.encode(), digest, target, again)
                out.write(raw)
                index.append((page_id, name, at, len(raw), url, digest))
                at += len(raw)
            columns = list(zip(*index, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in INDEX.split(", ")])
        if out is not None:
            out.close()

    return run


def write(pages: DataFrame, root: str) -> DataFrame:
    """Write the archives of all pages below ``root``; returns their index."""
    rows = payloads(pages)
    content = F.when(F.octet_length("html") >= REVISIT_BYTES, F.unhex(F.sha2("html", 256)))
    keyed = rows.withColumn("digest", F.sha1("html")).withColumn("content", content)
    again = F.col("target").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("target"))
    marked = keyed.join(targets(rows), "content", "left").withColumn("again", again)
    return stage(marked.select("page_id", "url", "html", "digest", "target", "again").mapInArrow(_write(root), INDEX), "warc-index")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _read(root: str, keep_payload: bool):
    def run(batches):
        from pyarrow import fs as pafs

        fs, base = pafs.FileSystem.from_uri(root)

        def fetch(name: str, want: list[tuple[int, int]]) -> Iterator[bytes]:
            with fs.open_input_file(f"{base}/{name}") as src:
                src.seek(want[0][0])
                data = src.read(want[-1][0] + want[-1][1] - want[0][0])
            for offset, length in want:
                yield zlib.decompress(data[offset - want[0][0] : offset - want[0][0] + length], wbits=31)

        def ranges(rows) -> Iterator[tuple[str, list[tuple[int, int]]]]:
            name, held = None, []
            for file, offset, length in rows:
                if held and (file != name or offset - sum(held[-1]) > GAP_BYTES or offset + length - held[0][0] > READ_BYTES):
                    yield name, held
                    held = []
                name = file
                held.append((offset, length))
            if held:
                yield name, held

        for batch in batches:
            out = []
            for name, want in ranges(rows_of(batch, "file", "offset", "length")):
                for raw in fetch(name, want):
                    fields, block = parse(raw)
                    kind, digest = fields["WARC-Type"], base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    if kind == "response" and (hashlib.sha1(block).hexdigest() != digest or len(block) != int(fields["X-Payload-Length"])):
                        raise ValueError(f"damaged record in {name}")
                    numbers = [re.search(r"page:(-?\d+)>", fields.get(k, "")) for k in ("WARC-Record-ID", "WARC-Refers-To")]
                    page_id, refers = (int(m[1]) if m else None for m in numbers)
                    out.append((page_id, fields["WARC-Target-URI"], kind, refers, int(fields["X-Payload-Length"]), digest, block if keep_payload else None))
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in RECORD.split(", ")])

    return run


def read(index: DataFrame, root: str, keep_payload: bool = True) -> DataFrame:
    """The records that the index rows name (filter the index to select)."""
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = index.select("file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return ranged.mapInArrow(_read(root, keep_payload), RECORD)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages, read every record back from the archives."""
    root = new_path(spark, "warc")
    return read(write(pages, root), root, keep_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
