"""Merkle manifest of a table: a binary hash tree for each group, and one over the roots of the groups.

The leaves are range-sorted by group and key.  Each partition packs its runs of one group into blocks,
the counts of the partitions give every run its place in the group, and each block builds the aligned
subtrees that lie in it whole.  The ragged nodes at its edges, some two dozen a block, are shuffled by
coordinate (group, level, index) and fold some levels at a time until one node a group is left.  Paths to
the root go down the same way, so that each block gets the siblings above its edges and writes the
proofs of its leaves by itself.

Only hashes, keys and places are shuffled; the rows are read once.  A group may hold any share of the
rows: its leaves spread over partitions by key, its nodes over tasks by coordinate.  Nothing is collected
but the number of levels.

Cases: a null group is a group of its own and the first; null keys come first; rows with equal group and
key follow each other by leaf, so rows that repeat are leaves of their own with proofs of their own; a
lone leaf is its group's root; a lone group's root is the root; an empty table has no rows in its
manifest.  Nulls, empty and very long texts hash like others.  Of the columns only those named are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, rows_of, scratch, stage

BLOCK = 4096  # leaves in a block
FIRST, NEXT = 5, 8  # levels that the first fold climbs beyond a block of mean size, and later ones beyond the fold before
DIGEST = 32

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def hashed_fields(*columns: Column) -> Column:
    """SHA-256 of the columns, each ``-`` if null, else its UTF-8 bytes behind their number and a colon."""

    def one(c: Column) -> Column:
        text = c.cast("string")
        return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*map(one, columns)), 256)


def climb(nodes: list[str], start: int, total: int) -> tuple[list[tuple[int, list[str]]], list[tuple[int, int, str]]]:
    """What neighbouring leaves of a tree of ``total`` leaves make by themselves.

    Returns for each level the first index and the nodes, and the ragged nodes as (level, index, hash):
    those whose parent needs a node from elsewhere, or the root.
    """
    levels, edges, lo, size = [], [], start, total
    while nodes:
        levels.append((lo, nodes))
        level, end = len(levels) - 1, lo + len(nodes)
        if size == 1:
            edges.append((level, 0, nodes[0]))
            break
        a, b = lo % 2, len(nodes)
        if a:
            edges.append((level, lo, nodes[0]))
        if end % 2 and end < size:
            edges.append((level, end - 1, nodes[-1]))
            b -= 1
        nodes, lo, size = [digest("".join(nodes[i : min(i + 2, b)])) for i in range(a, b, 2)], (lo + a) // 2, -(-size // 2)
    return levels, edges


def entry(index: int, sibling: str | None) -> str:
    """A step of a path: the side of the sibling and its hash, or a dash if a node is alone in its run."""
    return "-" if sibling is None else ("L" if index % 2 else "R") + sibling


def steps(path: str) -> list[str]:
    out, at = [], 0
    while at < len(path):
        end = at + (1 if path[at] == "-" else 2 * DIGEST + 1)
        out.append(path[at:end])
        at = end
    return out


def folded(node: str, path: list[str]) -> str:
    """The root that a node and the steps above it lead to."""
    for s in path:
        node = digest(s[1:] + node if s[0] == "L" else node + s[1:])
    return node


def height(total: int) -> int:
    return (total - 1).bit_length()


def _blocks(items: DataFrame, order: list[Column]) -> DataFrame:
    """Rows ``part, seq, grp, ids, leaves, probes``: runs of one group in order, at most ``BLOCK`` leaves each."""
    key = dict(items.dtypes)["id"]
    spread = items.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    names = ("part", "grp", "id", "leaf", "probe")
    kinds = {"grp": pa.string(), "leaves": pa.binary(), "probes": pa.binary()}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        seq, kind = 0, None

        def block() -> pa.RecordBatch:
            part, grp = held[0][:2]
            columns = {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int64()), "grp": pa.array([grp], kinds["grp"]), "ids": pa.array([[r[2] for r in held]], pa.list_(kind))}
            columns |= {name: pa.array([b"".join(r[k] for r in held)], kinds[name]) for k, name in ((3, "leaves"), (4, "probes"))}
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            kind = batch.column("id").type
            for grp, rows in groupby(rows_of(batch, *names), key=lambda r: r[1]):
                for row in rows:
                    if held and (held[0][1] != grp or len(held) == BLOCK):
                        yield block()
                        held.clear()
                        seq += 1
                    held.append(row)
        if held:
            yield block()

    numbered = spread.select(F.spark_partition_id().alias("part"), "grp", "id", F.unhex("leaf").alias("leaf"), F.unhex("probe").alias("probe"))
    return stage(numbered.mapInArrow(pack, f"part int, seq long, grp string, ids array<{key}>, leaves binary, probes binary"), "merkle-blocks")


def _placed(blocks: DataFrame) -> DataFrame:
    """``part, seq, start, total``: the place of each block in its group, by the counts of the partitions before it."""
    meta = blocks.select("part", "seq", "grp", F.size("ids").cast("long").alias("n"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = meta.groupBy("part", "grp").agg(F.sum("n").alias("n"))
    offsets = runs.select("part", "grp", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy("grp")).alias("total"))
    own = Window.partitionBy("part", "grp").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    inner = meta.select("part", "seq", "grp", F.coalesce(F.sum("n").over(own), F.lit(0)).alias("inner"))
    return inner.join(offsets, ["part", "grp"]).select("part", "seq", (F.col("offset") + F.col("inner")).alias("start"), "total")


NODE = "grp string, total long, level int, idx long, hash string"
EDGE = f"part int, seq long, start long, {NODE}"
LINK = f"{NODE}, up int, up_idx long, path string, made boolean"


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for part, seq, grp, leaves, start, total in rows_of(batch, "part", "seq", "grp", "leaves", "start", "total"):
            _, edges = climb(split(leaves), start, total)
            out += [(part, seq, start, grp, total, *e) for e in edges]
        yield table_of(out, EDGE)


def split(digests: bytes) -> list[str]:
    return [digests[i : i + DIGEST].hex() for i in range(0, len(digests), DIGEST)]


KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def table_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.strip().split(" ") for f in schema.split(",")]
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _fold(top: int):
    """Folds all nodes below one coordinate of level ``top``: links each to the node there, and makes that node."""

    def run(group: pa.Table) -> pa.Table:
        given = list(rows_of(group, "grp", "total", "level", "idx", "hash"))
        grp, total = given[0][:2]
        last = min(top, height(total))
        size = [-(-total // (1 << k)) for k in range(last + 1)]
        nodes: list[dict[int, str]] = [{} for _ in size]
        for _, _, level, idx, h in given:
            nodes[level][idx] = h
        for k in range(last):
            for p in {i // 2 for i in nodes[k]}:
                nodes[k + 1][p] = digest(nodes[k][2 * p] + nodes[k].get(2 * p + 1, ""))
        rows = []
        for _, _, level, idx, h in given:
            path = "".join(entry(i, nodes[k][i ^ 1] if i ^ 1 < size[k] else None) for k, i in ((k, idx >> (k - level)) for k in range(level, last)))
            rows.append((grp, total, level, idx, h, last, idx >> (last - level), path, False))
        at = rows[0][6]
        rows.append((grp, total, last, at, nodes[last][at], last, at, "", True))
        return pa.Table.from_batches([table_of(rows, LINK)])

    return run


def _links(nodes: DataFrame, top: int, levels: int) -> list[DataFrame]:
    """Folds ``nodes`` up to level ``top``, then further, until one a group is left; the links of each fold, the last one's to the groups' roots."""
    out = []
    while True:
        at = F.when(F.lit(top) - F.col("level") > 62, 0).otherwise(F.expr(f"shiftright(idx, {top} - level)")).alias("at")
        done = stage(nodes.select("grp", "total", "level", "idx", "hash", at).groupBy("grp", "at").applyInArrow(_fold(top), LINK), "merkle-links")
        out.append(done)
        if top >= levels:
            return out
        nodes, top = done.where("made"), top + NEXT


def _tree(items: DataFrame, order: list[Column]) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    blocks = _blocks(items, order)
    sized = blocks.join(_placed(blocks), ["part", "seq"])
    edges = stage(sized.select("part", "seq", "grp", "leaves", "start", "total").mapInArrow(_edges, EDGE), "merkle-edges")
    largest, highest = edges.agg(F.max("total"), F.max("level")).first()
    if largest is None:
        return blocks, edges, []
    mean_run = blocks.agg(F.avg(F.size("ids"))).first()[0]
    return blocks, edges, _links(edges, max(highest, height(max(1, round(mean_run))) + FIRST), height(largest))


def _paths(edges: DataFrame, links: list[DataFrame], above: DataFrame) -> DataFrame:
    """The path of each edge to the root: ``above`` has ``grp, over, subroot, root`` of the groups' roots."""
    known = None
    for done in reversed(links):
        own = done.where("not made")
        if known is None:
            reach = own.join(above, "grp").select("grp", "level", "idx", F.concat("path", "over").alias("path"), "subroot", "root")
        else:
            up = known.select("grp", F.col("level").alias("up"), F.col("idx").alias("up_idx"), F.col("path").alias("over"), "subroot", "root")
            reach = own.join(up, ["grp", "up", "up_idx"]).select("grp", "level", "idx", F.concat("path", "over").alias("path"), "subroot", "root")
        known = reach
    return edges.join(known, ["grp", "level", "idx"])


def _proofs(keep_path: bool):
    """Turns blocks with the paths above their edges into rows: the siblings within the block, then those above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, leaves, probes, start, total, subroot, root, above in zip(*(batch.column(n) if n == "ids" else batch.column(n).to_pylist() for n in ("ids", "leaves", "probes", "start", "total", "subroot", "root", "above")), strict=True):
                levels, _ = climb(nodes := split(leaves), start, total)
                out: list[tuple] = [()] * len(nodes)
                size = [-(-total // (1 << k)) for k in range(len(levels))]
                probes_ = split(probes)
                for edge in above:
                    level, idx, upper = edge["level"], edge["idx"], steps(edge["path"])
                    for i in range(max(start, idx << level), min((idx + 1) << level, start + len(nodes))):
                        path = []
                        for k in range(level):
                            j = i >> k
                            path.append(entry(j, levels[k][1][(j ^ 1) - levels[k][0]] if j ^ 1 < size[k] else None))
                        path += upper
                        proof = digest("".join(s[1:] for s in path))
                        out[i - start] = (nodes[i - start], subroot, root, proof, folded(probes_[i - start], path), path if keep_path else None)
                columns = list(zip(*out, strict=True))
                arrays = [ids.values, *(pa.array(c, pa.string()) for c in columns[:5])]
                names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
                if keep_path:
                    arrays, names = [*arrays, pa.array(columns[5], pa.list_(pa.string()))], [*names, "proof"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _finished(items: DataFrame, order: list[Column], above, keep_path: bool) -> DataFrame:
    """``id, leaf, subroot, root, proof_sha256, folded_root`` of each item; ``above`` turns the groups' roots into their paths."""
    key = dict(items.dtypes)["id"]
    schema = f"id {key}, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + (", proof array<string>" if keep_path else "")
    blocks, edges, links = _tree(items, order)
    if not links:
        return items.sparkSession.createDataFrame([], schema)
    roots = links[-1].where("made").select("grp", F.col("hash").alias("subroot"))
    paths = _paths(edges, links, above(roots))
    per_block = paths.groupBy("part", "seq").agg(F.collect_list(F.struct("level", "idx", "path")).alias("above"), *(F.any_value(c).alias(c) for c in ("start", "total", "subroot", "root")))
    return blocks.join(per_block, ["part", "seq"]).mapInArrow(_proofs(keep_path), schema)


def _over_groups(roots: DataFrame) -> DataFrame:
    """The tree over the groups' roots, in the order of the groups: the path of each to the root."""
    items = roots.select(F.lit("").alias("grp"), F.col("grp").alias("id"), F.col("subroot").alias("leaf"), F.col("subroot").alias("probe"))
    alone = lambda top: top.select("grp", F.lit("").alias("over"), "subroot", F.col("subroot").alias("root"))
    found = _finished(items, [F.col("id")], alone, keep_path=True)
    return stage(found.select(F.col("id").alias("grp"), F.array_join("proof", "").alias("over"), F.col("leaf").alias("subroot"), "root"), "merkle-groups")


def manifest(rows: DataFrame, key: str, group: str, leaf: Column, probe: Column | None = None, proofs: bool = False) -> DataFrame:
    """The manifest of ``rows``: key, leaf, subroot, root, proof_sha256, folded_root, verified of each, and with ``proofs`` the proof itself.

    ``leaf`` is the hash of a row as it was recorded, ``probe`` the hash of the row as it is found now; ``folded_root``
    comes of the probe and the recorded siblings.  A proof holds a step a level: the side of the sibling (L or R)
    and its hash, or a dash where a node is alone.
    """
    bounded_batches(rows.sparkSession)
    scratch(rows.sparkSession)
    named = F.when(F.col(group).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(group).cast("string")))
    items = rows.select(named.alias("grp"), F.col(key).alias("id"), leaf.alias("leaf"), (leaf if probe is None else probe).alias("probe"), F.monotonically_increasing_id().alias("tie"))
    found = _finished(items, [F.col("id").asc_nulls_first(), F.col("leaf"), F.col("tie")], _over_groups, proofs)
    return found.withColumnRenamed("id", key).withColumn("verified", F.col("folded_root") == F.col("root"))


def document_manifest(docs: DataFrame, proofs: bool = False) -> DataFrame:
    """Manifest of documents by language; where 7 divides the CRC-32 of ``doc_id``, a document is probed with one character more than recorded."""
    columns = {c: F.col(c) for c in FIELDS}
    changed = columns | {"n_chars": F.col("n_chars").cast("decimal(38,0)") + 1}
    probed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    leaf = hashed_fields(*columns.values())
    return manifest(docs, "doc_id", "lang", leaf, F.when(probed, hashed_fields(*changed.values())).otherwise(leaf), proofs)
