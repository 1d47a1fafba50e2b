"""The training-data operators against brute force, on fixtures with nulls, ties, copies and odd texts."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import bottomk, common, decontaminate, exact_dedup, lexicon, pieces, quality, reshard, token_counts, token_files, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(400))
TEXTS = [
    "The quick brown fox jumps over the lazy dog again and again until night", "the QUICK brown fox jumps over the lazy dog again and again until night", None, "", " ", "one", "One", "two words",
    LONG, LONG + " extra", LONG.replace("w7 ", "x7 "), "日本語 テスト <|endoftext|> it's  ½", "a\tb\r\nc", "x" * 5000, "école É ÉCOLE",
]
ROWS = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(TEXTS)] + [(100, LONG, None, None, None), (101, LONG, "de", "s1", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    common.bounded_batches(spark)
    return spark.createDataFrame(ROWS, DOCS)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_exact_dedup(docs):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs).collect()}
    groups = defaultdict(list)
    for i, t, *_ in ROWS:
        groups[lower(t)].append(i)
    assert got == {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


def test_exact_dedup_stream_keeps_state(spark, docs, tmp_path):
    root = f"file://{tmp_path}"
    for part in (docs.where("doc_id < 9"), docs.where("doc_id >= 9")):
        exact_dedup.land(part, f"{root}/landing")
        exact_dedup.run_stream(spark, f"{root}/landing", f"{root}/entries", f"{root}/state")
    got = {r.doc_id: r.keep_id for r in exact_dedup.decisions(spark, f"{root}/landing", f"{root}/entries").collect()}
    assert (got[8], got[0], got[2], len(got)) == (101, 1, 3, len(ROWS))


def test_near_duplicates(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in bottomk.near_duplicates(docs, width=2).collect()}
    sets = {}
    for i, t, *_ in ROWS:
        w = lower(t).encode().split()
        sets[i] = set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(x):
        return x if up[x] == x else find(up[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_near_duplicates_around_the_sketch_size(spark):
    # one text and the same with up to a quarter of new words: each pair is at 0.8 or more and has no other partner
    rows, expected = [], {}
    for p, n in enumerate([656, 690, 725, 733, 780, 819, 820, 900, 1000, 1024, 1040]):
        text = [f"p{p}w{i}" for i in range(n)]
        for q, more in enumerate((n // 4, n // 5)):
            a = 1000 * q + 10 * p + 1
            # words that occur nowhere else come before those of both in the order of rarity
            pair = [f"{q}{w}" for w in text], [f"{q}{w}" for w in text] + [f"{q}p{p}new{i}" for i in range(more)]
            for i, words in enumerate(pair):
                assert i == 0 or 5 * n >= 4 * len(words)
                rows.append((a + i, " ".join(words)))
                expected[a + i] = a
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in bottomk.near_duplicates(table, width=1).collect()} == expected


def test_poster_meets_every_pair_over_the_threshold(spark):
    from fractions import Fraction
    from types import SimpleNamespace

    import pyarrow as pa

    t, k = Fraction("0.8"), 1024
    for n, m in [(820, 656), (819, 656), (860, 690), (900, 725), (915, 732), (1024, 820), (1024, 1024)]:
        both = [f"w{i}" for i in range(m)]
        texts = [" ".join(both), " ".join(both + [f"x{i}" for i in range(n - m)])]
        batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": texts})
        # a table in which every value of both documents is more common than any other
        counts = bottomk.shingle_hashes(next(h for *_, h in common.hashed_words(*common.text_buffers(batch.column("text")[:1]), common.WHITE)), 1)
        rare = np.zeros(1 << 21, np.int32)
        rare[(counts & np.uint64(len(rare) - 1)).astype(np.int64)] = 2
        posted = defaultdict(set)
        for out in bottomk.poster(SimpleNamespace(value=rare), 1, k, t)(iter([batch])):
            for value, doc in common.rows_of(out, "value", "doc_id"):
                posted[doc].add(value)
        assert posted[1] & posted[2], (n, m)


def test_decontaminate(spark, docs):
    bench = spark.createDataFrame([(1, LONG[:200]), (2, "two words"), (3, None), (4, "")], "item_id long, text string")
    for block in (10, 10**6):
        got = {r.doc_id: r for r in decontaminate.report(docs, bench, block_words=block).collect()}
        assert (got[8].n_items, got[8].contaminated, got[7].n_hit, got[0].n_hit, got[2].n_words) == (1, True, 2, 0, 0)
        assert got[7].items_sha256 == hashlib.sha256(b"2").hexdigest()
    assert decontaminate.report(docs, bench.limit(0)).where("n_hit > 0").isEmpty()


def test_token_files(docs):
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(common.tokenizer_path("byte_bpe_50k.json")), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.round_trip(docs).collect()}
    for i, t, *_ in sorted(ROWS, key=lambda r: r[0]):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_huffman_lengths():
    counts = np.array([0, 5, 1, 1, 1, 100, 0, 3])
    lengths = token_files.code_lengths(counts, 4)
    assert lengths.max() <= 4 and lengths[0] == 0 and abs(sum(2.0 ** -lengths[lengths > 0].astype(float)) - 1) < 1e-12


def test_token_counts(docs):
    rows = token_counts.token_counts(docs).orderBy("n_tokens").collect()
    assert sum(r.docs for r in rows) == len(ROWS) and rows[-1].docs_over == 0
    totals = {r.limit: r.total for r in token_counts.truncated_totals(token_counts.histogram(docs), [1, 10**6]).collect()}
    assert totals[10**6] == rows[-1].tokens_up_to


def test_lexicon(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(common.tokenizer_path("word_bpe_49k.json"))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in lexicon.digests(docs, words=50).collect()}
    for i, t, *_ in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_warc(spark):
    pages = spark.createDataFrame([(1, "u", "p" * 2000), (5, None, "p" * 2000), (3, "u", "p" * 2000), (4, "u", None), (6, "a\nb", "x"), (7, "u", "x")], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(spark, pages).collect()}
    assert got == {1: (2000, "revisit", 5), 5: (2000, "response", None), 3: (2000, "revisit", 5), 4: (0, "response", None), 6: (1, "response", None), 7: (1, "response", None)}


def test_resharding(docs):
    rows = reshard.shard_documents(docs).collect()
    slots = defaultdict(set)
    for r in rows:
        slots[r.shard].add(r.slot)
    assert len(rows) == len(ROWS) and all(s == set(range(len(s))) for s in slots.values())
    assert reshard.flows({0: 10, 1: 2}, [6, 6]) == {(0, 0): 6, (0, 1): 4, (1, 1): 2}


def test_classifiers_learn(spark):
    d = "/root/testdata/sf0.01"
    table, labels = common.documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")
    known = quality.quality(table, labels.where("doc_id % 4 <> 0")).join(labels.where("doc_id % 4 = 0"), "doc_id")
    assert known.agg(F.avg((F.col("keep").cast("int") == F.col("quality")).cast("int"))).first()[0] > 0.9


def test_co_training_covers_the_corpus(spark):
    # good and bad texts differ; 20 documents of a source without a label lie in a corpus of more than 6,000
    rows = [(i, ("aaa bbb ccc " if i % 2 else "xxx yyy zzz ") * 5, "en", "good" if i % 2 else "bad", 60) for i in range(7000)]
    # these ids hash highest, so that no bounded sample by hash has one
    rare = spark.range(10_000, 12_000).orderBy(F.desc(F.xxhash64("id", F.lit(1)))).limit(20).collect()
    rows += [(r.id, "aaa bbb ccc " * 5, "fr", "rare", 60) for r in rare]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    model = quality.train(spark.createDataFrame(rows, DOCS), labels)
    assert model.meta[32 + zlib.crc32(b"rare") % 128] > 1e-4 and model.meta[zlib.crc32(b"fr") % 32] > 1e-4
    assert quality.last_taught(np.array([3, 0, 5, 2]), 4) == (2, 0.2)


@pytest.mark.parametrize("run", [exact_dedup.exact_dedup, bottomk.near_duplicates, token_files.round_trip, token_counts.token_counts, lexicon.digests, reshard.shard_documents])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], DOCS)).isEmpty()


def brute_components(rows, width, num, den):
    """Least id of each row's component by comparing the word sets of all pairs."""
    sets = {i: shingle_set(t, width) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both * den >= (len(sets[a]) + len(sets[b]) - both) * num:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def shingle_set(text, width):
    w = lower(text).encode().split()
    n = min(width, len(w))
    return set(zip(*(w[j:] for j in range(n)), strict=False)) if w else set()


def test_hot_lists_over_many_components(spark):
    # families around a base of which each member replaces, drops or adds some words: lists of many members and components
    r = np.random.default_rng(7)
    rows, n = [], 0
    for family, size in enumerate((60, 45, 12)):
        base = [f"f{family}w{i}" for i in range(40 + 17 * family)]
        for m in range(size):
            words = list(base)
            for at in r.choice(len(words), int(r.integers(0, 8)), replace=False):
                words[at] = f"x{family}v{int(r.integers(0, 9))}"
            cut = int(r.integers(0, 9))
            words = words[cut:] + [f"t{family}z{int(r.integers(0, 20))}" for _ in range(int(r.integers(0, 7)))]
            rows.append((n := n + 1, " ".join(words)))
    # short texts of two very common words and little else
    rows += [(n + 1 + i, " ".join(["aa", "bb"] * int(r.integers(1, 3)) + [f"s{int(r.integers(0, 30))}" for _ in range(int(r.integers(0, 5)))])) for i in range(80)]
    expected = brute_components(rows, 2, 80, 100)
    assert len({c for _, c, _ in expected.values()}) > 20
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in bottomk.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    assert got == expected


def test_hash_defeating_words_stay_apart(spark):
    # Thue-Morse words and their complements have equal polynomial hashes modulo 2**64, whatever the base
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(9001, word), (9002, word.translate(str.maketrans("ab", "ba"))), (9003, word.upper()), (9004, f"{word} {word}")]
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in bottomk.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    assert got == brute_components(rows, 2, 80, 100)


ODD = ["’quoted’ “text” — dash… • €5", "日本語の文章です。", "Привет, мир! Ещё раз", "مرحبا بالعالم", "emoji 😀👍🏽 here", "ΟΔΥΣΣΕΥΣ Σ σς", "İstanbul ß ﬁ ²³½ Ⅷ", "école İ x　y\x85z",
       "don't 'tis it's'll '' 's 'S they'Re", "  two  spaces \n\n\t x  ", "a1b22c ３٣", "_under_ score!?!", "<|endoftext|> mid <|endoftext|>", "x" * 100 + " " + "é" * 60, "", None, "\0\0 \x1c\x1f"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoders_equal_the_library(name):
    path = common.tokenizer_path(name)
    encoder = pieces.byte_encoder(path) if name.startswith("byte") else lexicon.WordEncoder(path)
    r = np.random.default_rng(3)
    letters = list("abst'''   \n1!_éßΣ½本“’") + ["'re", "'ll", "'s"]
    texts = ODD + ["".join(r.choice(letters, int(r.integers(0, 30)))) for _ in range(3000)]
    expected = [encoder.library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encoder.arrays(texts)] == expected
    assert encoder.lengths(texts).tolist() == [len(x) for x in expected]
    assert sum(encoder.splitter.plain(t) is None for t in ODD) == 1  # only special tokens fall back


def test_large_vocabularies_round_trip():
    r = np.random.default_rng(1)
    ids = np.concatenate([np.arange(200_000), r.integers(0, 200_000, 5000)])
    code = token_files.Code(token_files.code_lengths(np.bincount(ids)))
    ends = np.array([100_000, len(ids)])
    data, starts, bit = code.encode(ids, ends)
    assert (code.decode(np.frombuffer(data.tobytes(), np.uint8), bit[np.array([0, 100_000])], np.array([100_000, len(ids) - 100_000])) == ids).all()


def test_ties_fill_the_lexicon(spark):
    from pathlib import Path

    from pyspark import SparkFiles

    rows = [(i, " ".join("".join(chr(97 + (j // 26**k) % 26) for k in range(4)) for j in range(i * 100, i * 100 + 100))) for i in range(40)]
    name = lexicon.compile_lexicon(spark.createDataFrame(rows, "doc_id long, text string"), common.tokenizer_path("word_bpe_49k.json"), words=3000)
    assert 2900 <= len(lexicon.Lexicon(str(Path(SparkFiles.getRootDirectory()) / name)).start) - 1 <= 3000


def test_token_counts_brute_force(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(common.tokenizer_path("byte_bpe_50k.json"))
    sizes = sorted(len(library.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in ROWS)
    rows = token_counts.token_counts(docs)
    for r in rows.collect():
        up = [n for n in sizes if n <= r.n_tokens]
        assert (r.docs, r.docs_up_to, r.tokens_up_to, r.docs_over, r.tokens_over) == (sizes.count(r.n_tokens), len(up), sum(up), len(sizes) - len(up), sum(sizes) - sum(up))
        assert r.truncated_total == sum(min(n, r.n_tokens) for n in sizes) and r.share_up_to == len(up) / len(sizes)
    for q in (0.1, 0.5, 0.99, 1.0):
        assert token_counts.quantile(rows, q).first().n_tokens == next(n for n in sizes if sum(x <= n for x in sizes) >= q * len(sizes))


def test_equal_texts_share_a_shard(spark):
    # one text exceeds a shard; all groups of ten stay together, also those that share its block
    rows = [(i, "hot " * 20) for i in range(3000)] + [(10_000 + 10 * g + c, f"text {g} of ten copies") for g in range(1500) for c in range(10)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = reshard.shard_documents(table).collect()
    held, groups, moved, size = defaultdict(int), defaultdict(set), 0, defaultdict(int)
    text = dict(rows)
    for r in got:
        t = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "bytes", None)
        held[r.shard] += r.size
        size[r.old_shard] += r.size
        moved += r.size * (r.old_shard != r.shard)
        groups[r.text_crc32].add(r.shard)
    assert len(got) == len(rows) and sorted(held) == list(range(16))
    assert [c for c, s in groups.items() if len(s) > 1] == [zlib.crc32(b"hot " * 20)]
    total = sum(held.values())
    assert max(held.values()) - min(held.values()) < 0.02 * total / 16
    best = sum(f for (i, j), f in reshard.flows(size, [total // 16 + (j < total % 16) for j in range(16)]).items() if i != j)
    assert best <= moved <= 1.02 * best


def test_untouched_shards_keep_their_files(spark, tmp_path):
    old, new = f"file://{tmp_path}/old", f"file://{tmp_path}/new"
    rows = [(i, f"t{i % 50:03d}", "was", i % 4 if i < 300 else 3) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, `to` string, shard int")
    table.write.partitionBy("shard").parquet(old)
    layout = {r.shard: r.root for r in reshard.reshard(spark, old, new, 4).collect()}
    assert set(layout) == {0, 1, 2, 3}
    back = [r for root in (old, new) for r in spark.read.option("basePath", root).parquet(root).collect() if layout[r.shard] == root]
    assert sorted(r.doc_id for r in back) == list(range(400)) and {r.to for r in back} == {"was"}
    again = {r.shard: r.root for r in reshard.reshard(spark, new, f"{new}2", 4).collect()} if set(layout.values()) == {new} else {new: new}
    assert set(again.values()) == {new}


CLASHES = ["__spans", "__score", "__digest", "o", "b", "p", "found", "row_kept", "doc_id_kept", "__k_doc_id", "times_kept", "n_words", "value", "digest", "shard2", "quality"]


@pytest.mark.parametrize("stage", ["quality_stage", "dedup_stage", "near_stage", "decontaminate_stage"])
def test_stages_keep_columns_of_any_name(spark, tmp_path, stage):
    rows = [(*r, *(f"{c}{r[0]}" for c in CLASHES)) for r in [*ROWS, (None, None, None, None, None), (7, "two words", "en", "s1", 9)]]
    table = spark.createDataFrame(rows, DOCS + "".join(f", `{c}` string" for c in CLASHES))
    spark.createDataFrame([(1, LONG[:200]), (2, None)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0), (7, 0, 1), (8, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    run = {f.__name__: f for f in (quality.quality_stage, exact_dedup.dedup_stage, bottomk.near_stage, decontaminate.decontaminate_stage)}[stage]
    out = run(spark, table, f"file://{tmp_path}")
    assert out.columns == table.columns
    got = out.collect()
    assert got and all(r[c] == f"{c}{r.doc_id}" for r in got for c in CLASHES)
    assert run(spark, table.limit(0), f"file://{tmp_path}").isEmpty()


def test_spans_are_cut_below_the_coverage(spark):
    item = [f"b{i}" for i in range(15)]
    clean = [f"c{i}" for i in range(400)]
    rows = [(1, " ".join([*clean[:200], *item, *clean[200:]])), (2, " ".join([*clean[:50], *item])), (3, " ".join(clean)), (4, None)]
    others = [(i, " ".join(f"o{i}{k}" for k in range(20))) for i in (2, 3)]
    bench = spark.createDataFrame([(1, " ".join(item)), *others], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    for words in (1, 30):
        again = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench, block_words=words).collect()
        assert {r.doc_id: r.text for r in again} == got
    assert got == {1: " ".join(clean), 3: " ".join(clean), 4: None}


def test_decontamination_brute_force(spark):
    import re

    r = np.random.default_rng(11)
    words = [f"w{i}" for i in range(12)] + ["É", "x-y"]
    items = [(i, " ".join(r.choice(words, int(r.integers(0, 30))))) for i in range(60)] + [(3, "w1 w2"), (None, "w3 w4 w5")]
    texts = [" ".join(r.choice(words, int(r.integers(0, 60)))) for _ in range(100)]
    texts += [f"{items[i][1].upper()} zz {' '.join(r.choice(words, 5))}" for i in range(40)] + [None, ""]
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for i, t in items:
        w = find(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add("" if i is None else str(i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (40, 10**6):
        got = {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in decontaminate.report(table, bench, block_words=block).collect()}
        for d, t in enumerate(texts):
            w, hit, names = find(t), set(), set()
            for win, own in windows.items():
                for k in range(len(w) - len(win) + 1):
                    if tuple(w[k : k + len(win)]) == win:
                        hit |= set(range(k, k + len(win)))
                        names |= own
            digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
            assert got[d] == (len(w), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(w)), (block, d)


def test_toxicity_of_rows_held_out(spark):
    d = "/root/testdata/sf0.1"
    table, labels = common.documents(spark, d), spark.read.parquet(f"{d}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    got = toxicity.toxicity(table, labels.where(~held)).withColumnRenamed("toxic", "said").join(labels.where(held), "doc_id")
    caught = {r.toxic: (r.share, r.n) for r in got.groupBy("toxic").agg(F.avg(F.col("said").cast("int")).alias("share"), F.count("*").alias("n")).collect()}
    assert caught[1][1] > 50 and caught[1][0] > 0.9 and caught[0][0] < 0.02


def test_grades_share_weights(spark):
    # severity 0 to 3 by a planted mixture; half of the labelled rows are held out
    r = np.random.default_rng(4)
    rows, grades = [], []
    for i in range(900):
        z = r.normal()
        bad, good = (int(x) for x in r.poisson(np.exp([0.9 * z + 1, 1 - 0.9 * z])))
        rows.append((i, " ".join(r.permutation(["vile"] * bad + ["kind"] * good + [f"w{int(r.integers(0, 50))}" for _ in range(20)]))))
        grades.append((i, int(np.searchsorted([0.2, 1.0, 1.8], z + 0.2 * r.normal()))))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(table, spark.createDataFrame(grades[:450], "doc_id long, toxic int"))
    assert len(model.thetas) == 3 and (np.diff(model.thetas) > 0).all()
    got = {x.doc_id: x.severity for x in toxicity.toxicity(table, spark.createDataFrame(grades[:450], "doc_id long, toxic int")).collect()}
    y, s = np.array([g for _, g in grades[450:]]), np.array([got[i] for i in range(450, 900)])
    means = [s[y == g].mean() for g in range(4)]
    assert np.corrcoef(y, s)[0, 1] > 0.7 and means == sorted(means)
    assert model.weights[np.searchsorted(model.words, toxicity.word_counts(__import__("pyarrow").array(["vile"]))[0][0][0])] > 0
    assert toxicity.toxicity(table.limit(0), spark.createDataFrame(grades[:4], "doc_id long, toxic int")).isEmpty()


def test_warc_ranges_of_selected_records(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}\r\n{i}", f"{'é' * (i % 7)}<p>{i}</p>" * (i % 40)) for i in range(300)] + [(None, None, None), (7, "again", "x")], "page_id long, url string, html string")
    index = warc.write(pages, f"file://{tmp_path}/w")
    assert index.where("url rlike '[\r\n]'").isEmpty() and index.count() == 302
    got = warc.read(index.where("page_id % 3 = 0"), f"file://{tmp_path}/w").collect()
    assert {(x.page_id, x.payload.decode() if x.payload else "") for x in got if x.record_type == "response"} == {(i, f"{'é' * (i % 7)}<p>{i}</p>" * (i % 40)) for i in range(0, 300, 3)}
    assert warc.round_trip(spark, pages.limit(0)).isEmpty()
