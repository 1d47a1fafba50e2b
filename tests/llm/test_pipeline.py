"""Every stage of the pipeline against brute force, each on what the stage before kept."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import bottomk, common, exact_dedup, quality
from tests.llm.test_operators import brute_components, lower

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `row` string"


def corpus():
    r = np.random.default_rng(5)
    rows = []
    for i in range(240):
        good = i % 3 > 0
        words = [f"{'good' if good else 'BAD*'}{int(r.integers(0, 90))}" for _ in range(int(r.integers(10, 60)))]
        rows.append((i, " ".join(words if good else ["$$$", *words, "###"]), "en", f"s{i % 3}", 10))
    item = " ".join(f"item{i}" for i in range(30))
    rows += [(300, f"{item} good1 good2", "en", "s1", 9), (301, rows[1][1].upper(), "en", "s1", 9), (302, rows[1][1], "en", "s1", 9), (303, rows[4][1] + " good1", "en", "s1", 9)]
    rows += [(304, None, "en", "s1", 9), (305, "", "en", "s2", 9), (7, rows[7][1], "en", "s1", 10), (306, "good1 " * 30_000, "en", "s1", 9), (None, "good1 good2 good3", "en", "s2", 1)]
    return [(*x, f"r{n}") for n, x in enumerate(rows)], [(1, item), (2, None)]


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """The rows before the first stage and after each."""
    d = f"file://{tmp_path_factory.mktemp('pipeline')}"
    rows, items = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 240, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs, out = common.documents(spark, d), [rows]
    for k, (_, run) in enumerate(corpus_pipeline.STAGES):
        docs = run(spark, docs, d)
        assert k == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "row"]
        docs.write.parquet(f"{d}/{k}")
        docs = spark.read.parquet(f"{d}/{k}")
        out.append([tuple(x) for x in docs.collect()])
    assert sorted(map(str, corpus_pipeline.run(spark, d).collect())) == sorted(map(str, docs.collect()))
    return d, out


def test_quality_keeps_good(spark, staged):
    d, out = staged
    kept = {x[5] for x in out[1]}
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = common.documents(spark, d)
    scores = docs.withColumn("s", quality.scored(docs, quality.train(docs, labels)))
    assert kept == {x.row for x in scores.where(F.col("s.score") >= quality.KEEP_AT).collect()}
    planted = [x for x in out[0] if x[0] is not None and x[0] < 240]
    assert np.mean([(x[5] in kept) == (x[0] % 3 > 0) for x in planted]) > 0.95


def test_one_of_equal_texts_stays(staged):
    _, out = staged
    groups = defaultdict(list)
    for x in out[1]:
        groups[lower(x[1])].append(x)
    best = {t: max((x[0] for x in g if x[0] is not None), default=None) for t, g in groups.items()}
    assert sorted((lower(x[1]), x[0]) for x in out[2] if x[0] is not None) == sorted((t, i) for t, i in best.items() if i is not None)
    assert len(out[2]) == len(groups) and {x[5] for x in out[2]} <= {x[5] for x in out[1]}


def test_one_of_near_copies_stays(staged):
    _, out = staged
    found = brute_components([(x[0], x[1]) for x in out[2] if x[0] is not None], 5, 80, 100)
    assert {x[0] for x in out[3] if x[0] is not None} == {i for i, (_, _, kept) in found.items() if kept}
    assert sum(x[0] is None for x in out[3]) == sum(x[0] is None for x in out[2])


def test_contaminated_go(staged):
    _, out = staged
    assert [x for x in out[3] if x[0] != 300] == out[4] or sorted(map(str, (x for x in out[3] if x[0] != 300))) == sorted(map(str, out[4]))


def test_encoding_equals_the_library(staged):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(common.tokenizer_path("word_bpe_49k.json"))
    expected = set()
    for x in staged[1][4]:
        ids = library.encode(x[1] or "", add_special_tokens=False).ids
        expected.add((x[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert set(staged[1][5]) == expected and len(staged[1][5]) == len(staged[1][4])


def test_empty_tables(spark, tmp_path):
    d = f"file://{tmp_path}"
    for name, schema in (("documents", SCHEMA), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{d}/{name}.parquet")
    assert corpus_pipeline.run(spark, d).isEmpty()


def test_stages_keep_columns_of_any_type(spark):
    """Maps, variants, arrays and structs beside the documents, with rows that repeat and rows that differ in a map alone."""
    text = " ".join(f"word{i}" for i in range(30))
    docs = spark.sql(f"""
        SELECT id AS doc_id, text, 'en' AS lang, 's' AS source, 5L AS n_chars, map(k, 1) AS tags, parse_json(concat('{{"a": "', k, '"}}')) AS meta, array(k) AS list, struct(k, map(k, k) AS m) AS nested
        FROM VALUES (1L, '{text}', 'x'), (1L, '{text}', 'y'), (1L, '{text}', 'y'), (2L, '{text} more', 'z'), (3L, NULL, 'w') AS v(id, text, k)""")
    exact = exact_dedup.dedup_stage(spark, docs, "")
    assert exact.dtypes == docs.dtypes
    assert sorted((r.doc_id, dict(r.tags)) for r in exact.collect()) == [(1, {"x": 1}), (2, {"z": 1}), (3, {"w": 1})]
    near = bottomk.near_stage(spark, docs, "")
    assert near.dtypes == docs.dtypes and sorted(r.doc_id for r in near.collect()) == [1, 3]
