"""Near-duplicate detection with bottom-k sketches from one hash function.

Every document becomes the set of its word shingles.  Its k smallest hashes are
retained (the whole set if it is no larger).  Documents with equal sets collapse
to one representative.  A representative enters the inverted lists of the
rarest of its retained values only: two documents that must share at least
``o`` values share one of the ``len - o + 1`` rarest, so a pair over the
threshold meets in some list, while a passage that a third of the corpus
repeats stays at the common end of the order and opens no list.  Rarity comes
from a table of hashed counts of fixed size, not from the corpus vocabulary, so
what is broadcast does not grow.

A list never yields all of its pairs.  Its members stand by how few rarer values
they have: the first is the most typical one, such as the original of many
copies.  The first few members meet each other, each later one meets the first
and in some lists the one before; shorter lists are thereby complete.  A value's
place also bounds the overlap of a pair, which drops most others.  What is left
passes an estimate from the union of two small sketches, then an exact
comparison of the full sets of words, and the links give components.

Longer lists that span several components are searched again.  Members whose
place leaves too few values for any other size in their list go, and so do the
lists that then hold one component only.  First each component of a list sends
one member to the list's best one, which is linear in postings; then the members
that are left meet those of other components, so no link between different texts
is lost.

Documents with equal sequences of words share a cryptographic digest and are one
class.  Whatever else has equal hashes is still compared on words.

Defined cases: null text or text without words has no shingles and is linked
with nothing; fewer words than a shingle count as one shingle; rows that share
a document id are one document whose links are pooled; a row without an id is
its own component (null) and kept; further columns of the input, whatever their
names, take no part; very long texts are hashed piece by piece.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, WHITE, bounded_batches, drop, hashed_words, mix, packed_counts, rows_of, stage, summed_counts, text_buffers

#: Ids that are broadcast at most (24 MB); with more the tables are joined.
BROADCAST_IDS = 1 << 20

#: A pair over the threshold is missed by its sketches with at most this probability.
MISS = 1e-9
#: Members of a list that each member meets directly; lists up to one more are complete.
NEAR = 4
#: Of the longer lists, one in so many gives its members a neighbour each.
SPREAD = 8
#: The table of counts has 4 to 8 buckets a document, but 2**MOST_BITS (64 MB) at most; fuller buckets only make lists longer.
MOST_BITS = 24
#: Size of the sketches that are estimated from before sets of words are compared.
ESTIMATE = 64


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of the shingles over a text's word hashes, ascending; fewer words are one shingle."""
    width = min(width, len(h))
    if not width:
        return h
    with np.errstate(over="ignore"):
        out = np.full(len(h) - width + 1, U64(width), U64)
        for j in range(width):
            out = out * U64(0x9E3779B97F4A7C15) + h[j : len(h) - width + 1 + j]
        out = np.sort(mix(out))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def shingled(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    """The shingle set of each text of a batch."""
    for first, last, places, _, _, h in hashed_words(*text_buffers(batch.column("text")), WHITE):
        for i in range(last - first):
            yield shingle_hashes(h[places[i] : places[i + 1]], width)


PROFILE = "doc_id long, digest binary, n_shingles long, sketch binary, chunk int, counts binary"


def profiler(width: int, k: int, bits: int) -> Callable:
    """doc_id, text -> a profile of each document, and this task's counts of the retained values.

    A profile is the digest of the words, the size of the set and its ``ESTIMATE`` least hashes.  Counts are kept in
    2**bits buckets of the hashes' low bits, a table of fixed size.
    """
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]

    def out(*columns):
        n = max(len(c) for c in columns if c is not None)
        return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in PROFILE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mask = np.zeros(1 << bits, np.int32), U64((1 << bits) - 1)
        for batch in batches:
            texts = batch.column("text").fill_null("").cast(pa.binary())
            digests = [hashlib.blake2b(b" ".join(x.as_py().lower().split()), digest_size=16).digest() for x in texts]
            sizes, sketches, held, n = [], [], [], 0
            for hs in shingled(batch, width):
                sizes.append(len(hs)), sketches.append(hs[:ESTIMATE].tobytes())
                held.append((hs[:k] & mask).astype(np.int64))
                n += len(held[-1])
                if n > 1 << 20:
                    total += np.bincount(np.concatenate(held), minlength=1 << bits).astype(np.int32)
                    held, n = [], 0
            if held:
                total += np.bincount(np.concatenate(held), minlength=1 << bits).astype(np.int32)
            if batch.num_rows:
                yield out(batch.column("doc_id"), digests, sizes, sketches, None, None)
        chunks, counts = packed_counts(total)
        if chunks:
            yield out(None, None, None, None, chunks, counts)

    return run


def sketch_overlap(k: int, t: float) -> int:
    """Values that two k-sketches share at least, but for probability MISS, at similarity t or more."""
    for o in range(int(k * t), 0, -1):
        p = o / k
        if p < t and k * (p * math.log(p / t) + (1 - p) * math.log((1 - p) / (1 - t))) >= -math.log(MISS):
            return o
    return 1


POSTING = "value long, doc_id long, facts long"


def packed(place: np.ndarray, room: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Place and room (at most k) and set size of a posting in one number that sorts by place."""
    return (place.astype(np.int64) << 48) | (room.astype(np.int64) << 32) | n


def poster(counts, width: int, k: int, t: Fraction) -> Callable:
    """doc_id, text -> a posting for each of the rarest retained values.

    ``place``: rarer values of the document; ``room``: values from this one on, which bounds an overlap.
    """
    overlap = sketch_overlap(k, float(t))

    def run(batches):
        rare = counts.value
        mask = U64(len(rare) - 1)
        for batch in batches:
            values, places, rooms, owners, sizes = [], [], [], [], []

            def out():
                times = [len(v) for v in values]
                facts = packed(np.concatenate(places), np.concatenate(rooms), np.repeat(np.array(sizes, np.int64), times))
                return pa.RecordBatch.from_arrays([pa.array(c) for c in (np.concatenate(values).view(np.int64), np.repeat(np.array(owners, np.int64), times), facts)], names=["value", "doc_id", "facts"])

            held = 0
            for doc_id, hs in zip(batch.column("doc_id").to_pylist(), shingled(batch, width), strict=True):
                n, v = len(hs), hs[:k]
                if not n or doc_id is None:
                    continue
                # a whole partner shares ceil(n * t) values at least, a sketched one the overlap of sketches
                need = min(-(-n * t.numerator // t.denominator), overlap)
                size = max(len(v) - need + 1, 1)
                v = v[np.lexsort((v, rare[(v & mask).astype(np.int64)]))[:size]]
                values.append(v), owners.append(doc_id), sizes.append(n)
                places.append(np.arange(size, dtype=np.int32)), rooms.append(min(n, k) - np.arange(size))
                held += size
                if held > 1 << 18:
                    yield out()
                    values, places, rooms, owners, sizes, held = [], [], [], [], [], 0
            if held:
                yield out()

    return run


NEARBY = "a long, b long, value long, doc_id long, n long, room long"


def neighbours(t: Fraction, k: int) -> Callable:
    """Postings sorted by value and place -> pairs of members (a < b), and the members of longer lists (a null)."""
    overlap = sketch_overlap(k, float(t))

    def run(batches):
        held = None
        for batch in batches:
            value, doc_id, facts = (batch.column(c).to_numpy() for c in ("value", "doc_id", "facts"))
            cols = [value, doc_id, facts & 0x7FFFFFFF, (facts >> 32) & 0xFFFF]
            start = len(held[0]) if held else 0
            v, d, n, room = (np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)) if held else cols
            at = np.arange(len(v))
            first = np.maximum.accumulate(np.where(np.concatenate([[True], v[1:] != v[:-1]]), at, 0))
            deep = np.concatenate([np.zeros(min(len(v), NEAR + 1), bool), v[NEAR + 1 :] == v[: -NEAR - 1]])
            new = at >= start
            meet = [(at[new & deep], first[new & deep])]
            for gap in range(1, NEAR + 1):
                i = at[max(start, gap) :]
                i = i[(v[i] == v[i - gap]) & (~deep[i] | (gap == 1) & (v[i] % SPREAD == 0))]
                meet.append((i, i - gap))
            i, j = (np.concatenate(x) for x in zip(*meet, strict=True))
            small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            need = np.where(large <= k, -(-(small + large) * t.numerator // (t.numerator + t.denominator)), overlap)
            ok = (small * t.denominator >= large * t.numerator) & (np.minimum(room[i], room[j]) >= need) & (d[i] != d[j])
            i, j = i[ok], j[ok]
            pairs = np.unique(np.stack([np.minimum(d[i], d[j]), np.maximum(d[i], d[j])], 1), axis=0) if len(i) else np.empty((0, 2), np.int64)
            # members of longer lists; with the first that is deep, those before it
            deep &= new
            opens = at[deep][~np.isin(at[deep] - 1, at[deep])]
            opens = opens[opens - first[opens] == NEAR + 1]
            more = np.concatenate([at[deep], *(opens - gap for gap in range(1, NEAR + 2))])
            nothing = pa.nulls(len(pairs), pa.int64()), pa.nulls(len(more), pa.int64())
            columns = [pa.concat_arrays([pa.array(pairs[:, c]), nothing[1]]) for c in (0, 1)]
            columns += [pa.concat_arrays([nothing[0], pa.array(x[more])]) for x in (v, d, n, room)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in NEARBY.split(", ")])
            if len(v):  # the last list's first member and its last few
                tail = np.unique(np.concatenate([[first[-1]], at[-NEAR - 1 :]]))
                held = [x[tail] for x in (v, d, n, room)]

    return run


def only_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is in a column of ``ids``; the ids are broadcast if they are few."""
    wanted = None
    for c in ids.columns:
        one = ids.select(F.col(c).alias("doc_id"))
        wanted = one if wanted is None else wanted.unionByName(one)
    wanted = stage(wanted.distinct(), "ids")
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")


def sides(pairs: DataFrame, rows: DataFrame, of: str) -> DataFrame:
    """Pairs with the column ``of`` of both documents as left and right."""
    left = rows.select(F.col("doc_id").alias("a"), F.col(of).alias("left"))
    right = rows.select(F.col("doc_id").alias("b"), F.col(of).alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")


def estimator(t: Fraction) -> Callable:
    """Keep pairs whose union sketch does not rule them out."""
    least = sketch_overlap(ESTIMATE, float(t))

    def run(batches):
        for batch in batches:
            keep = [may_be_similar(np.frombuffer(x, U64), np.frombuffer(y, U64), float(t), least) for x, y in rows_of(batch, "left", "right")]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def may_be_similar(x: np.ndarray, y: np.ndarray, t: float, least: int) -> bool:
    """Estimate from the union of two sketches: False only if similarity t is ruled out."""
    union = np.union1d(x, y)
    whole = len(x) < ESTIMATE and len(y) < ESTIMATE
    union = union if whole else union[:ESTIMATE]
    both = np.intersect1d(np.intersect1d(x, y, assume_unique=True), union, assume_unique=True)
    return len(both) >= (t * len(union) * (1 - 1e-12) if whole else min(least, len(union)))


def verifier(width: int, t: Fraction) -> Callable:
    """Keep pairs of texts whose full shingle sets are similar enough: the words decide."""

    def shingles(text: bytes) -> set:
        w = text.lower().split()  # of bytes: A-Z and ASCII white space only
        n = min(width, len(w))
        return set(zip(*(w[j:] for j in range(n)), strict=False)) if w else set()

    def run(batches):
        for batch in batches:
            keep, last, left = [], None, set()
            for a, x, y in zip(batch.column("a").to_pylist(), *(batch.column(c).fill_null("").cast(pa.binary()).to_pylist() for c in ("left", "right")), strict=True):
                if a != last:
                    last, left = a, shingles(x)
                right = shingles(y)
                both = len(left & right)
                keep.append(both > 0 and both * t.denominator >= (len(left) + len(right) - both) * t.numerator)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def _local_stars(batches):
    """Replace the edges of a batch by a star to the least member of each of its components."""
    for batch in batches:
        up: dict[int, int] = {}

        def find(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up.setdefault(y, y)
            return x

        for a, b in rows_of(batch, "a", "b"):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        pairs = [(r, x) for x in up if (r := find(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """doc_id, component of all documents with an edge (a, b): alternating large and small stars.

    Minima are written before they are joined, so that a join has an exchange on
    both sides and Spark can split a hub's edges.
    """
    edges = stage(edges.mapInArrow(_local_stars, "a long, b long").distinct(), "edges")
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = stage(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = stage(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        drop(edges, least)
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        kept = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(kept.unionByName(least.select("u", F.col("m").alias("v"))).distinct().select(F.col("v").alias("a"), F.col("u").alias("b")), "edges")
        drop(large, least)
        # done when each document hangs on one other, which hangs on none
        roots = stage(edges.select(F.col("a").alias("b")).distinct(), "roots")
        nested = edges.join(roots, "b", "left_semi").limit(1)
        done = edges.groupBy("b").count().where("count > 1").limit(1).union(nested).isEmpty()
        drop(roots)
        if done:
            return edges.select(F.col("b").alias("doc_id"), F.col("a").alias("component"))


def contested(members: DataFrame, t: Fraction, k: int) -> DataFrame:
    """Of the members (value, doc_id, n, room, part) of lists, those that may have a link to another part of their list."""
    num, den = t.numerator, t.denominator
    least = F.greatest(F.ceil(F.col("n") * num / den), F.col("least"))
    need = F.least((F.col("n") + least) * num, F.lit(sketch_overlap(k, float(t)) * (num + den)))
    for name in ("open", "across"):
        lists = members.groupBy("value").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.min("n").alias("least")).where("lo < hi")
        lists, before = stage(lists.select(F.col("value").alias("of"), "least"), "lists"), members
        alive = (F.col("value") == F.col("of")) & (F.col("room") * (num + den) >= need) & (F.col("least") * num <= F.col("n") * den)
        members = stage(members.join(lists, alive).select(*members.columns), name)
        drop(lists, before)
    return members


def pairs_across(left: DataFrame, right: DataFrame, t: Fraction, k: int) -> DataFrame:
    """Pairs a < b of members of different parts of a list whose sizes and places allow a link."""
    num, den = t.numerator, t.denominator
    right = right.select(*(F.col(c).alias(f"r_{c}") for c in ("value", "doc_id", "n", "room", "part")))
    need = F.when(F.greatest("n", "r_n") <= k, (F.col("n") + F.col("r_n")) * num).otherwise(sketch_overlap(k, float(t)) * (num + den))
    fits = (
        (F.col("value") == F.col("r_value"))
        & (F.col("part") != F.col("r_part"))
        & (F.least("n", "r_n") * den >= F.greatest("n", "r_n") * num)
        & (F.least("room", "r_room") * (num + den) >= need)
    )
    return left.join(right, fits).select(F.least("doc_id", "r_doc_id").alias("a"), F.greatest("doc_id", "r_doc_id").alias("b")).distinct()


def links(docs: DataFrame, profiles: DataFrame, reps: DataFrame, counts: np.ndarray, width: int, t: Fraction, k: int) -> DataFrame:
    """Components (doc_id, component) of the representatives linked at similarity t or more."""
    counts = docs.sparkSession.sparkContext.broadcast(counts)  # of a fixed size
    postings = only_ids(docs, reps).mapInArrow(poster(counts, width, k, t), POSTING)
    lists = postings.repartition("value").sortWithinPartitions("value", "facts", "doc_id")
    near = stage(lists.mapInArrow(neighbours(t, k), NEARBY), "near")
    sketches = profiles.where("n_shingles > 0").select("doc_id", "sketch")

    def confirmed(pairs: DataFrame) -> DataFrame:
        # small sketches first, so that texts are shuffled for few pairs but links
        likely = stage(sides(pairs, only_ids(sketches, pairs), "sketch").mapInArrow(estimator(t), "a long, b long").distinct(), "likely")
        found = stage(sides(likely, only_ids(docs, likely), "text").mapInArrow(verifier(width, t), "a long, b long").distinct(), "links")
        drop(likely)
        return found

    def joined(parts: DataFrame, pairs: DataFrame) -> DataFrame:
        return components(parts.select(F.col("component").alias("a"), F.col("doc_id").alias("b")).unionByName(confirmed(pairs)))

    def in_parts(members: DataFrame) -> DataFrame:
        found = members.select("value", "doc_id", "n", "room").join(parts, "doc_id", "left")
        return contested(stage(found.select("value", "doc_id", "n", "room", F.coalesce("component", "doc_id").alias("part")), "members"), t, k)

    parts = components(confirmed(stage(near.where("a is not null").select("a", "b").distinct(), "pairs")))
    open_lists = in_parts(near.where("a is null"))
    # one member of each part meets the best of the list
    best = F.max(F.struct("room", "n", "doc_id", "part")).alias("m")
    firsts = open_lists.groupBy("value", "part").agg(best).select("value", "m.doc_id", "m.n", "m.room", "m.part")
    hubs = open_lists.groupBy("value").agg(best).select("value", "m.doc_id", "m.n", "m.room", "m.part")
    some = stage(pairs_across(stage(firsts, "firsts"), stage(hubs, "hubs"), t, k), "pairs")
    if not some.isEmpty():
        parts = joined(parts, some)
        open_lists = in_parts(open_lists)
    more = stage(pairs_across(open_lists, open_lists, t, k).join(some, ["a", "b"], "left_anti"), "pairs")
    return parts if more.isEmpty() else joined(parts, more)


def near_duplicates(docs: DataFrame, width: int = 5, threshold: Fraction | str = "0.8", k: int = 1024) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id, kept (the least id of its component)."""
    t = Fraction(threshold)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bits = min(max(docs.count().bit_length() + 2, 16), MOST_BITS)
    staged = stage(docs.mapInArrow(profiler(width, k, bits), PROFILE), "profiles")
    profiles = staged.where("chunk is null").drop("chunk", "counts")
    counts = summed_counts(staged.where("chunk is not null").select("chunk", "counts"), 1 << bits)
    # copies share a digest; the representative's component is theirs
    least = stage(profiles.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    parts = links(docs, profiles, least.select("rep"), np.minimum(counts, 1 << 30).astype(np.int32), width, t, k)
    classes = stage(least.join(parts.withColumnRenamed("doc_id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component")), "classes")
    rows = profiles.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    alone = rows.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    grouped = rows.where("digest is not null").join(classes, "digest").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    return grouped.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the document with the least id of each component stays; 5-word shingles, 0.8 or more."""
    bounded_batches(spark)
    from .exact_dedup import keep_rows

    kept = near_duplicates(docs).where("kept").groupBy("doc_id").agg(F.count("*").alias("times"))
    # rows that repeat an id are one document: one of them stays; rows without an id are never compared
    return keep_rows(docs, stage(kept, "kept").withColumn("times", F.when(F.col("doc_id").isNull(), 1).otherwise(F.col("times"))), {"doc_id": F.col("doc_id").cast("long")})
