"""The registered query of each training-data operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bottomk, decontaminate, exact_dedup, hamerly, lexicon, merkle, pivots, quality, reshard, token_counts, token_files, toxicity, warc
from .common import bounded_batches, documents


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return warc.round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.digests(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.near_duplicates(documents(spark, sf_dir), width=2, threshold="0.8")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshard.shard_documents(documents(spark, sf_dir))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(documents(spark, sf_dir))


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamerly.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_decontaminate, op2_token_files, op3_warc, op4_quality, op5_token_counts,
            op6_bpe, op7_toxicity, op8_exact_dedup, op9_near_dedup, op10_sharding,
            op11_merkle, op12_top_k, op13_clusters,
        )
    }


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"


def _merkle_sql(levels: int = 40) -> str:
    """Trees level by level; a leaf's place on a level is its place on the first divided by a power of two."""
    leaf = lambda n_chars: "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"
    crc = "list_reduce(list_prepend(4294967295::BIGINT, range(0, 8 * strlen(doc_id::VARCHAR))), lambda c, k: CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END)"
    crc = crc.format("(CASE WHEN k % 8 = 0 THEN xor(c, ascii(substr(doc_id::VARCHAR, (k // 8 + 1)::INT, 1))) ELSE c END)")
    return f"""
        WITH RECURSIVE d AS MATERIALIZED (
          SELECT doc_id, coalesce('v' || lang, 'n') AS g, {leaf('n_chars')} AS leaf, coalesce(xor({crc}, 4294967295) % 7 = 0, false) AS probed, {leaf('(n_chars::HUGEINT + 1)')} AS changed FROM documents),
        l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
        t AS (SELECT g, 0 AS k, i, n AS size, leaf AS h FROM l
              UNION ALL
              SELECT g, k + 1, i // 2, (any_value(size) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE size > 1 GROUP BY g, k, i // 2),
        tree AS MATERIALIZED (SELECT * FROM t),
        r AS MATERIALIZED (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS gi, count(*) OVER () AS gn FROM tree WHERE size = 1),
        u AS (SELECT 0 AS k, gi AS i, gn AS size, subroot AS h FROM r
              UNION ALL
              SELECT k + 1, i // 2, (any_value(size) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE size > 1 GROUP BY k, i // 2),
        upper AS MATERIALIZED (SELECT * FROM u),
        paths AS MATERIALIZED (
          SELECT l.g, l.i AS leaf_i, t.k, (l.i >> t.k) % 2 = 1 AS on_right, s.h FROM l JOIN tree t ON t.g = l.g AND t.i = l.i >> t.k AND t.size > 1 LEFT JOIN tree s ON s.g = t.g AND s.k = t.k AND s.i = xor(t.i, 1::BIGINT)
          UNION ALL
          SELECT l.g, l.i, {levels} + t.k, (r.gi >> t.k) % 2 = 1, s.h FROM l JOIN r ON r.g = l.g JOIN upper t ON t.i = r.gi >> t.k AND t.size > 1 LEFT JOIN upper s ON s.k = t.k AND s.i = xor(t.i, 1::BIGINT)),
        p AS MATERIALIZED (SELECT g, leaf_i AS i, list({{'r': on_right, 'h': coalesce(h, '')}} ORDER BY k) AS path FROM paths GROUP BY g, leaf_i),
        f AS (SELECT l.g, l.i, 1 AS k, coalesce(p.path, []) AS path, CASE WHEN probed AND changed IS NOT NULL THEN changed ELSE leaf END AS h FROM l LEFT JOIN p ON p.g = l.g AND p.i = l.i
              UNION ALL
              SELECT g, i, k + 1, path, sha256(CASE WHEN path[k].r THEN path[k].h || h ELSE h || path[k].h END) FROM f WHERE k <= len(path))
        SELECT l.doc_id, l.leaf, r.subroot, w.h AS root, sha256(list_aggregate(list_transform(f.path, lambda x: x.h), 'string_agg', '')) AS proof_sha256, f.h AS folded_root, f.h = w.h AS verified
        FROM l JOIN r ON r.g = l.g JOIN f ON f.g = l.g AND f.i = l.i AND f.k = len(f.path) + 1 CROSS JOIN (SELECT h FROM upper WHERE size = 1) w"""


#: DuckDB: a vector is there and its components are finite.
_WHOLE = "embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)"


def _clusters_sql(rounds: int = 3, k: int = 16, dim: int = 64) -> str:
    """Every round is two tables: the nearest centroid of each vector, then the centroids."""
    near = "SELECT rid, any_value(vec_id) AS vec_id, any_value(y) AS y, arg_min(c, d * 64 + c) AS c, min(d) AS d FROM (SELECT v.rid, v.vec_id, v.y, k.c, list_sum(list_transform(range(1, {dim} + 1), lambda i: (v.y[i] - k.m[i]) * (v.y[i] - k.m[i])))::BIGINT AS d FROM v CROSS JOIN k{r} k) GROUP BY rid"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding AS e, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS y FROM embeddings WHERE len(embedding) = {dim} AND {_WHOLE})",
        f"k0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, e) - 1 AS c, y AS m FROM v QUALIFY c < {k})",
    ]
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED ({near.format(dim=dim, r=r)})")
        mean = f"SELECT c, list(floor_mean ORDER BY i) AS m FROM (SELECT c, i, (sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS floor_mean FROM (SELECT c, unnest(y) AS x, generate_subscripts(y, 1) AS i FROM a{r}) GROUP BY c, i) GROUP BY c"
        parts.append(f"k{r + 1} AS MATERIALIZED (SELECT k.c, coalesce(n.m::BIGINT[], k.m) AS m FROM k{r} k LEFT JOIN ({mean}) n ON n.c = k.c)")
    parts.append(f"z AS MATERIALIZED ({near.format(dim=dim, r=rounds)})")
    return f"""
        WITH {", ".join(parts)}
        SELECT z.vec_id, z.c::INT AS cluster, z.d AS distance, (sum(z.d) OVER (PARTITION BY z.c))::BIGINT AS cluster_inertia, (sum(z.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(k.m, ',')) AS centroid_sha256
        FROM z JOIN k{rounds} k ON k.c = z.c"""


def oracle_sql() -> dict[str, str]:
    return {
        "op8_exact_dedup": """
            WITH t AS (
              SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
              FROM documents)
            SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
                   doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
            FROM t""",
        "op3_warc": """
            WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
                 t AS (SELECT page_id, n, d, max(page_id) OVER (PARTITION BY d, n) AS target FROM p)
            SELECT page_id, n AS payload_bytes, d AS payload_digest,
                   CASE WHEN n >= 1000 AND page_id <> target THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN n >= 1000 AND page_id <> target THEN target END AS refers_to
            FROM t""",
        "op11_merkle": _merkle_sql(),
        "op12_top_k": f"""
            WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS y FROM embeddings WHERE vec_id IS NOT NULL AND {_WHOLE}),
            s AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(range(1, least(len(q.y), len(c.y)) + 1), lambda i: q.y[i] * c.y[i])), 0)::BIGINT AS score
                  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
            SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
        "op13_clusters": _clusters_sql(),
    }
