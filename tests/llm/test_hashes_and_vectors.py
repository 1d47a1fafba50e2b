"""The Merkle manifest, exact top-k and centroid clustering against brute force, on fixtures with nulls, ties, copies and odd vectors."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from scriptorium.llm import hamerly, merkle, pivots

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
H = merkle.digest


def leaf_of(row, more=0):
    i, text, lang, source, n = row[:5]
    n = None if n is None else n + more
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def proofs_of(nodes):
    """The root and, for each leaf, its siblings as (is left, hash or None)."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            j = i ^ 1
            paths[leaf].append((j < i, nodes[j] if j < len(nodes) else None))
            at[leaf] = i // 2
        nodes = [H("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def manifest_of(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[g] = proofs_of([leaf_of(r) for r in groups[g]])
    root, over = proofs_of([trees[g][0] for g in names])
    out = []
    for g, up in zip(names, over, strict=True):
        for r, path in zip(groups[g], trees[g][1], strict=True):
            node = leaf_of(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for left, h in path + up:
                node = H((h or "") + node) if left else H(node + (h or ""))
            out.append((r[0], leaf_of(r), trees[g][0], root, H("".join(h or "" for _, h in path + up)), node, node == root))
    return out


def compared(spark, rows):
    got = merkle.document_manifest(spark.createDataFrame(rows, DOCS).repartition(5))
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert got.columns == list(names)
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == Counter(manifest_of(rows))


def test_manifest(spark):
    texts = ["a", None, "", "日本語", "x" * 50_000, "tab\tline\n"]
    rows = [(i, texts[i % 6], ("en", "en", "en", "de", None, "", "zz", "é")[i % 8], f"s{i % 3}" if i % 5 else None, None if i % 11 == 0 else i) for i in range(300)]
    rows += [(7, "again", "en", None, 1), (None, "no id", "en", "s", 2**63 - 1), (5, texts[5], "lone", "s1", 2**63 - 1)] + [rows[9]] * 3
    compared(spark, rows)


def test_manifest_of_hot_group_with_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "FIRST", 1)
    monkeypatch.setattr(merkle, "NEXT", 2)
    compared(spark, [(i, f"t{i}", "en" if i % 10 else f"g{i}", "s", i) for i in range(700)])


def test_manifest_of_few_rows(spark):
    for n in (1, 2, 3):
        compared(spark, [(i, "t", "en", None, None) for i in range(n)])
    empty = merkle.document_manifest(spark.createDataFrame([], DOCS))
    assert empty.collect() == [] and empty.columns[0] == "doc_id"


def test_manifest_ignores_clashing_columns_and_returns_proofs(spark):
    rows = [(i, f"t{i}", "en", "s", 3) for i in range(9)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS + ", leaf string, grp string")
    for r in merkle.document_manifest(docs, proofs=True).collect():
        assert merkle.folded(r.leaf, r.proof) == r.root and H("".join(s[1:] for s in r.proof)) == r.proof_sha256


@pytest.mark.parametrize("n", [1, 2, 5, 8, 13, 64, 100])
def test_local_subtrees_leave_what_others_need(n):
    """Runs of any cut fold to the root through their ragged nodes alone."""
    rng = random.Random(n)
    leaves = [H(str(i)) for i in range(n)]
    for _ in range(10):
        cuts = [0, *sorted(rng.randrange(n + 1) for _ in range(3)), n]
        nodes = defaultdict(dict)
        for a, b in zip(cuts, cuts[1:], strict=False):
            for level, i, h in merkle.climb(leaves[a:b], a, n)[1]:
                nodes[level][i] = h
        size, level = n, 0
        while size > 1:
            for p in {i // 2 for i in nodes[level]}:
                nodes[level + 1][p] = H(nodes[level][2 * p] + nodes[level].get(2 * p + 1, ""))
            size, level = -(-size // 2), level + 1
        assert nodes[level][0] == proofs_of(leaves)[0]


VECTORS = "vec_id long, embedding array<float>, label int"


def floors(v, scale):
    return [math.floor(Fraction(float(np.float32(x))) * scale) for x in v]


def is_whole(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def top_of(rows, every, k):
    kept = [(i, floors(v, 1024)) for i, v, *_ in rows if i is not None and is_whole(v)]
    out = []
    for q, y in kept:
        if q % every == 0:
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(y, z, strict=False)))), i) for i, z in kept if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return Counter(out)


def top_found(spark, rows, **options):
    got = pivots.top_k(spark.createDataFrame(rows, VECTORS).repartition(6), "vec_id", "embedding", **options)
    return Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect())


def clustered(rng, n, dim, spread):
    centers = rng.normal(size=(8, dim))
    return [(centers[i % 8] + spread * rng.normal(size=dim)).astype(np.float32).tolist() for i in range(n)]


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v, i) for i, v in enumerate(clustered(rng, 400, 16, 0.05))]
    rows += [(1000 + i, rows[3][1], 0) for i in range(150)]  # a hot vector
    rows += [(2000, None, 1), (2100, [1.0, None], 1), (2200, [float("nan")], 1), (2300, [float("inf")] * 16, 1), (2400, [], 1), (2500, [0.5, -0.25], 1), (None, [9.0] * 16, 1), (2600, [0.0] * 16, 1)]
    rows += [rows[0], (2700, [-3.0] * 16, 1), (2701, [70000.0] * 16, 1)]
    assert top_found(spark, rows) == top_of(rows, 100, 10)


def test_top_k_prunes_clusters_and_keeps_results(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, v, 0) for i, v in enumerate(clustered(rng, 600, 8, 0.01))]
    assert top_found(spark, rows, every=20, k=4, pivots=8) == top_of(rows, 20, 4)
    points = [np.floor(1024 * np.array([r[1]], np.float64)).astype(np.int64) for r in rows[:8]]
    vectors = spark.createDataFrame(rows, VECTORS).selectExpr("vec_id AS id", "embedding AS vector", "vec_id AS row")
    parts = pivots.Parts(pivots.build_index(vectors, points, 1024))
    query = points[0]
    scores = sorted((int((query[0] * np.floor(1024 * np.array(r[1], np.float64)).astype(np.int64)).sum()) for r in rows), reverse=True)
    assert (parts.bounds(query, points)[0] < scores[10]).sum() > len(parts.keys) / 2


def test_top_k_of_huge_components_and_few_rows(spark):
    rows = [(100, [3e38, 1.0], 0), (1, [-3e38, 2.0], 0), (2, [1.0, 1.0], 0), (200, [1e12, 1e12], 0)]
    assert top_found(spark, rows) == top_of(rows, 100, 10)
    assert not top_found(spark, [(3, None, 0)]) and not top_found(spark, [(3, [1.0], 0)]) and not top_found(spark, [(100, [1.0], 0)])


def clusters_of(rows, dim, k, rounds, scale):
    kept = [(i, v, floors(v, scale)) for i, v, *_ in rows if is_whole(v) and len(v) == dim]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [y for _, _, y in order[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    nearest = lambda y: min(range(len(centroids)), key=lambda c: (far(y, centroids[c]), c))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, _, y in kept:
            members[nearest(y)].append(y)
        centroids = [[sum(x) // len(members[c]) for x in zip(*members[c], strict=True)] if members[c] else old for c, old in enumerate(centroids)]
    of = [(i, c := nearest(y), far(y, centroids[c])) for i, _, y in kept]
    inertia = Counter()
    for _, c, d in of:
        inertia[c] += d
    top = lambda x: min(x, 2**63 - 1)
    return Counter((i, c, top(d), top(inertia[c]), top(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in of)


def clusters_found(spark, rows, **options):
    got = hamerly.cluster(spark.createDataFrame(rows, VECTORS).repartition(5), "vec_id", "embedding", **options)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return Counter(tuple(r) for r in got.collect())


def test_clusters(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v, i) for i, v in enumerate(clustered(rng, 300, 64, 0.3))]
    rows += [(1000 + i, rows[3][1], 0) for i in range(100)] + [rows[0]] * 3
    rows += [(2000, None, 1), (2001, [1.0, 2.0], 1), (2002, [None] * 64, 1), (2003, [float("nan")] * 64, 1), (2004, [float("-inf")] * 64, 1), (2005, [0.0] * 64, 1), (None, [0.25] * 64, 1)]
    assert clusters_found(spark, rows) == clusters_of(rows, 64, 16, 3, 64)


@pytest.mark.parametrize("rounds", [0, 1, 8])
def test_clusters_with_ties_on_a_grid(spark, rounds):
    rows = [(i, [float(i % 7), float(i // 7 % 5)], 0) for i in range(105)]
    assert clusters_found(spark, rows, dim=2, k=6, rounds=rounds, scale=2) == clusters_of(rows, 2, 6, rounds, 2)


def test_clusters_of_few_and_huge_vectors(spark):
    rows = [(1, [3e38, -1.0], 0), (2, [1.0, 1.0], 0), (3, [3e38, -1.0], 0), (4, [2e38, 5.0], 0)]
    assert clusters_found(spark, rows, dim=2, k=2) == clusters_of(rows, 2, 2, 3, 64)
    assert clusters_found(spark, rows[1:2], dim=2) == clusters_of(rows[1:2], 2, 16, 3, 64)
    assert not clusters_found(spark, [(1, None, 0)])


def test_bounds_spare_scans_and_never_lie():
    """Over rounds of moving centroids the bounds hold, and vectors of tight clusters are not compared again."""
    rng = np.random.default_rng(6)
    vectors = np.floor(64 * np.array(clustered(rng, 400, 16, 0.02))).astype(np.int64)
    centroids = hamerly.Centroids(vectors[:8].tolist())
    clusters, upper, lower, scanned = hamerly.nearest(vectors, centroids)
    assert scanned == 400
    for _ in range(4):
        moved = [(vectors[clusters == c].sum(axis=0) // max(1, (clusters == c).sum())).tolist() if (clusters == c).any() else centroids.rows[c] for c in range(8)]
        centroids = hamerly.Centroids(moved, centroids)
        clusters, upper, lower, scanned = hamerly.nearest(vectors, centroids, clusters, upper, lower)
        all_ = np.sqrt(((vectors[:, None] - centroids.points[None]) ** 2).sum(axis=2))
        assert (clusters == all_.argmin(axis=1)).all()
        rest = np.where(np.arange(8)[None] == clusters[:, None], np.inf, all_).min(axis=1)
        assert (upper >= all_.min(axis=1)).all() and (lower <= rest).all()
    assert scanned < 40
