"""Minimum-cost-flow resharding.

The corpus lies in files below ``shard=<n>`` folders.  It is cut into blocks by
text hash within each old shard, so equal texts share a block; blocks are bounded
in number, and only their byte sums reach the driver.  A minimum-cost flow from
old shard sizes to new capacities (keeping bytes in place is free, moving one
costs 1) says how many bytes go where; whole blocks are then assigned to these
flows, and the small differences that whole blocks leave are evened out, at no
cost where possible.  A block that exceeds a shard is cut by a second hash of the
text, and only a text that by itself exceeds a shard by document id.  The shards
that gain or lose rows are rewritten in ranges of (shard, doc_id), so that no task
gets a whole shard; the others keep their files.  Rows are numbered from the
files: place in the file plus the rows of the shard's earlier files.

The law is ``bytes``: shard sizes are near equal.  A row's size is the UTF-8
length of its text (null: none) plus 1.

Defined cases: a null id sorts first and is placed by its text; repeated rows
are rows of their own; an empty table has no rows and no files; texts of any
length are one row; further columns stay, whatever their names, but ``shard``,
which is the layout's own.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, new_path, stage

SHARDS, OLD_SHARDS, BLOCKS = 16, 12, 12_288


def min_cost_flow(n: int, edges: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each edge (from, to, capacity, cost) of a largest flow of least cost: successive shortest paths."""
    graph: list[list[int]] = [[] for _ in range(n)]
    to, cap, cost = [], [], []
    for u, v, c, w in edges:
        for a, b, x, y in ((u, v, c, w), (v, u, 0, -w)):
            graph[a].append(len(to))
            to.append(b), cap.append(x), cost.append(y)
    while True:
        far, via = [float("inf")] * n, [-1] * n
        far[source], changed = 0, True
        while changed:
            changed = False
            for u in range(n):
                for e in graph[u] if far[u] < float("inf") else ():
                    if cap[e] > 0 and far[u] + cost[e] < far[to[e]]:
                        far[to[e]], via[to[e]], changed = far[u] + cost[e], e, True
        if far[sink] == float("inf"):
            return [cap[2 * i + 1] for i in range(len(edges))]
        push, v = float("inf"), sink
        while v != source:
            push, v = min(push, cap[via[v]]), to[via[v] ^ 1]
        v = sink
        while v != source:
            cap[via[v]] -= push
            cap[via[v] ^ 1] += push
            v = to[via[v] ^ 1]


def flows(old: dict[int, int], capacities: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from each old shard to each new one that move the fewest bytes."""
    olds, m = sorted(old), len(capacities)
    source, sink = len(olds) + m, len(olds) + m + 1
    edges = [(source, i, old[s], 0) for i, s in enumerate(olds)]
    edges += [(len(olds) + j, sink, c, 0) for j, c in enumerate(capacities)]
    pairs = [(i, j) for i in range(len(olds)) for j in range(m)]
    edges += [(i, len(olds) + j, old[olds[i]], int(olds[i] != j)) for i, j in pairs]
    flow = min_cost_flow(sink + 1, edges, source, sink)
    return {(olds[i], j): f for (i, j), f in zip(pairs, flow[len(olds) + m :], strict=True) if f}


def plan(blocks: list[tuple[int, int, int]], capacities: list[int], rounds: int = 4000) -> dict[tuple[int, int], int]:
    """New shard of each block (old shard, block, bytes): blocks fill the flows, largest first."""
    old: dict[int, int] = defaultdict(int)
    for s, _, size in blocks:
        old[s] += size
    quota = defaultdict(dict)
    for (s, j), f in flows(old, capacities).items():
        quota[s][j] = f
    out, held = {}, [0] * len(capacities)
    for s, b, size in sorted(blocks, key=lambda x: (-x[2], x[0], x[1])):
        # where the flow still has most room; without any flow left, where the shard has
        j = max(quota[s], key=lambda j: (quota[s][j], j == s, -j), default=None)
        if j is None or quota[s][j] <= 0:
            j = min(range(len(capacities)), key=lambda j: (held[j] - capacities[j], j))
        else:
            quota[s][j] -= size
        out[s, b], held[j] = j, held[j] + size
    # rounding to whole blocks leaves small differences: move small blocks from the fullest to the emptiest,
    # those first that thereby come home, then those that are not at home anyway
    inside = defaultdict(list)
    for s, b, size in blocks:
        inside[out[s, b]].append((size, s, b))
    for _ in range(rounds):
        over = [h - c for h, c in zip(held, capacities, strict=True)]
        hi, lo = max(range(len(over)), key=over.__getitem__), min(range(len(over)), key=over.__getitem__)
        want = (over[hi] - over[lo]) / 2
        fit = [x for x in inside[hi] if 0 < x[0] < 2 * want]
        if not fit:
            break
        best = min(fit, key=lambda x: ((x[1] != lo) - (x[1] != hi), abs(x[0] - want)))
        inside[hi].remove(best)
        inside[lo].append(best)
        out[best[1], best[2]] = lo
        held[hi], held[lo] = held[hi] - best[0], held[lo] + best[0]
    return out


def uneven(crc: Column, shards: int) -> Column:
    """An old layout whose shards took hash ranges of growing width (shard i in proportion to i + 1)."""
    return F.least(F.floor((F.sqrt(1 + F.lit(4.0 * shards * (shards + 1)) * (crc / float(1 << 32))) - 1) / 2), F.lit(shards - 1)).cast("int")


#: Parts of a block that exceeds a shard: whole texts by hash, and single texts that exceed a shard by doc_id.
PARTS = 64


def placed(docs: DataFrame, old: Column, shards: int = SHARDS, name: str = "to") -> DataFrame:
    """``docs`` with the new shard of each row in a column ``name``; the plan has some ``BLOCKS`` rows, whatever the corpus."""
    spark = docs.sparkSession
    was, block, part, size, whole, to, own, key = fresh(docs.withColumn(name, F.lit(0)), "was", "block", "part", "size", "whole", "to_shard", "own", "key")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    by_text, by_id = F.xxhash64(text), F.xxhash64(F.col("doc_id").cast("string"))
    # another hash than that of the old layout, so that blocks of a shard are even
    keyed = docs.withColumns({was: old.cast("int"), block: F.pmod(by_text, F.lit(BLOCKS // OLD_SHARDS)).cast("int"), size: F.octet_length(text).cast("long") + 1})
    sums = [(r[was], r[block], r.bytes) for r in keyed.groupBy(was, block).agg(F.sum(size).alias("bytes")).collect()]  # bounded by BLOCKS
    total = sum(n for *_, n in sums)
    capacities = [total // shards + (j < total % shards) for j in range(shards)]
    most = max(capacities, default=0)
    blocks = [(s, b * 4 * PARTS, n) for s, b, n in sums if n <= most]
    large = sorted((s, b) for s, b, n in sums if n > most)  # fewer than ``shards``
    unit = F.lit(0)
    if large:
        in_large = F.struct(was, block).isin([F.struct(F.lit(s), F.lit(b)) for s, b in large])
        inside = keyed.where(in_large).withColumn(own, by_text)
        alone = [r[own] for r in inside.groupBy(own).agg(F.sum(size).alias("bytes")).where(F.col("bytes") > most).select(own).collect()]  # fewer than ``shards``
        part_of = 1 + F.pmod(F.shiftright(by_text, 20), F.lit(PARTS))
        if alone:
            part_of = F.when(by_text.isin(alone), 2 * PARTS + F.pmod(by_id, F.lit(PARTS))).otherwise(part_of)
        unit = F.when(in_large, part_of).otherwise(unit)
        cut = inside.withColumn(part, part_of).groupBy(was, block, part).agg(F.sum(size).alias("bytes")).collect()  # 2 * PARTS * shards at most
        blocks += [(r[was], r[block] * 4 * PARTS + r[part], r.bytes) for r in cut]
    rows = [(s, u, j) for (s, u), j in plan(blocks, capacities).items()]
    chosen = spark.createDataFrame(rows, f"`{own}` int, `{key}` int, `{to}` int")
    on = (F.col(was) == F.col(own)) & (F.col(block) * 4 * PARTS + unit.cast("int") == F.col(key))
    return keyed.join(F.broadcast(chosen), on).select(*(F.col(f"`{c}`") for c in docs.columns), F.col(to).alias(name))


def rewrite(rows: DataFrame, root: str) -> None:
    """Write the rows of each shard (column ``shard``) in doc_id order; large shards over many tasks."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # equal ids are parted by their size
    dealt = rows.repartitionByRange(n, "shard", "doc_id", F.octet_length("text")).sortWithinPartitions("shard", "doc_id")
    dealt.write.option("compression", "zstd").partitionBy("shard").parquet(root)


def reshard(spark: SparkSession, old_root: str, new_root: str, shards: int, schema: str | None = None) -> DataFrame:
    """Move a sharded table (``shard=<n>`` folders) to a new shard count, rewriting affected shards only.

    Returns shard and folder of the new layout, a row a shard: untouched shards keep their old folder.
    """
    table = spark.read.schema(schema).parquet(old_root) if schema else spark.read.parquet(old_root)
    (to,) = fresh(table, "to")
    moved = placed(table, F.col("shard"), shards, to)
    pairs = stage(moved.select("shard", F.col(to).alias("into")).distinct(), "moves")  # at most old x new rows
    gone = pairs.where("shard <> into")
    affected = gone.select("shard").union(gone.select("into")).distinct()
    mine = moved.drop("shard").withColumnRenamed(to, "shard")
    rewrite(mine.join(F.broadcast(affected), "shard"), new_root)
    kept = pairs.where("shard = into").select("shard").join(affected, "shard", "left_anti").select("shard", F.lit(old_root).alias("root"))
    return stage(kept.unionByName(affected.join(pairs.select(F.col("into").alias("shard")).distinct(), "shard").select("shard", F.lit(new_root).alias("root"))), "layout")


TABLE = "doc_id long, text string, shard int"


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Lay all documents out in ``OLD_SHARDS`` uneven shards, reshard them, and report each row from the files."""
    spark = docs.sparkSession
    old_root, new_root = new_path(spark, "old-shards"), new_path(spark, "shards")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows.withColumn("shard", uneven(F.crc32(text.cast("binary")), OLD_SHARDS)).write.option("compression", "zstd").partitionBy("shard").parquet(old_root)
    layout = [tuple(r) for r in reshard(spark, old_root, new_root, shards, TABLE).collect()]  # a row a shard
    back = None
    for root in (old_root, new_root):
        own = [s for s, r in layout if r == root]
        part = spark.read.schema(TABLE).parquet(root).where(F.col("shard").isin(own) if own else F.lit(False))
        part = part.select("doc_id", "text", "shard", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
        back = part if back is None else back.unionByName(part) if own else back
    order = F.regexp_extract("file", r"part-(\d+)", 1).cast("int")
    files = stage(back.groupBy("shard", "file").agg(F.count("*").alias("n")), "shard-files")
    earlier = Window.partitionBy("shard").orderBy(order, "file").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))  # a row a file
    crc = F.crc32(text.cast("binary"))
    return back.join(bases, "file").select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        crc.alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("base") + F.col("at")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        uneven(crc, OLD_SHARDS).alias("old_shard"),
    )
