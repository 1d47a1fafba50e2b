"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words become one automaton (built in blocks of bounded size, one
broadcast at a time).  Documents are hashed word by word without Python
objects; only runs of words that the items know, long enough to hold a window,
are streamed through the automaton, which tracks the longest match ending at
each word.  Where that length reaches the window, the window is an item's; the
state of exactly that length names the items.  Items shorter than a window are
windows as a whole and are found on the chain of suffix links.

Defined cases: null text or text without words has no words and no hits; an
item without words is no window; an item without id has the empty id; items
that share an id count once; repeated documents are judged row by row; an
empty benchmark leaves all documents clean; an empty table has no rows; texts of
any length are scanned whole; further columns, whatever their names, stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM_WORD, NOT_ALNUM, U64, bounded_batches, fresh, hashed_words, stage, text_buffers

WINDOW = 13
#: Item words in one automaton; larger benchmarks take several passes over the texts.
BLOCK_WORDS = 100_000


class ItemAutomaton:
    """Suffix automaton of several word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.word_ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.word_ids.setdefault(w, len(self.word_ids)) for w in words]) for name, words in items if words]
        for _, seq in coded:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        self.least = min((min(window, len(seq)) for _, seq in coded), default=0)
        # the state on each suffix chain whose lengths include the window
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        self.gate = [-1] * len(order)
        for v in order[1:]:
            if self.length[v] >= window:
                up = self.link[v]
                self.gate[v] = self.gate[up] if self.length[up] >= window else v
        self.items: dict[int, set[str]] = {}
        whole: dict[int, list[tuple[int, str]]] = {}
        for name, seq in coded:
            v = n = 0
            for c in seq:
                v, n = self.next[v][c], n + 1
                if n >= window:
                    self.items.setdefault(self.gate[v], set()).add(name)
            if n < window:
                whole.setdefault(v, []).append((n, name))
        self.short: list[tuple[tuple[int, str], ...]] = [()] * len(order)
        if whole:
            for v in order[1:]:
                self.short[v] = tuple(whole.get(v, ())) + self.short[self.link[v]]
        # hashes of the known words, to tell unknown ones without looking at their letters
        known = sorted(self.word_ids)
        data = np.frombuffer(b" ".join(known), np.uint8)
        self.hashes = np.sort(next(hashed_words(data, np.array([0, len(data)]), NOT_ALNUM, len(data) + 1))[5]) if known else np.empty(0, U64)
        self.low = np.zeros(1 << 18, bool)
        self.low[(self.hashes & U64((1 << 18) - 1)).astype(np.int64)] = True

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves), self.link.append(link), self.length.append(length)
        return len(self.next) - 1

    def _extend(self, p: int, c: int) -> int:
        grown = self.length[p] + 1
        known = self.next[p].get(c)
        if known is not None and self.length[known] == grown:
            return known
        cur = None if known is not None else self._state(grown, 0, {})
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p < 0:
            return cur
        q = self.next[p][c]
        if self.length[q] > self.length[p] + 1:
            twin = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
            while p >= 0 and self.next[p].get(c) == q:
                self.next[p][c] = twin
                p = self.link[p]
            self.link[q] = twin
            q = twin
        if cur is None:
            return q
        self.link[cur] = q
        return cur

    def known(self, h: np.ndarray) -> np.ndarray:
        """Which word hashes belong to item words."""
        out = self.low[(h & U64(len(self.low) - 1)).astype(np.int64)]
        at = np.flatnonzero(out)
        place = np.minimum(np.searchsorted(self.hashes, h[at]), max(len(self.hashes) - 1, 0))
        out[at] = self.hashes[place] == h[at] if len(self.hashes) else False
        return out

    def stream(self, words: list[bytes], first: int, spans: list[tuple[int, int]], items: set[str]) -> int:
        """Walk the words; add hit spans (word places, end exclusive) and items; return the longest match."""
        nexts, link, length, window = self.next, self.link, self.length, self.window
        v = n = longest = 0
        for i, word in enumerate(words, first + 1):
            c = self.word_ids.get(word)
            if c is None:
                v = n = 0
                continue
            while v and c not in nexts[v]:
                v = link[v]
                n = length[v]
            if c in nexts[v]:
                v, n = nexts[v][c], n + 1
            longest = max(longest, n)
            if n >= window:
                spans.append((i - window, i))
                items |= self.items[self.gate[v]]
            for size, name in self.short[v]:
                if size <= n:
                    spans.append((i - size, i))
                    items.add(name)
        return longest


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def blocks(bench: DataFrame, window: int, block_words: int) -> Iterator[ItemAutomaton]:
    """Automata over the items, a bounded number of words in each; items reach the driver one at a time."""
    held, size = [], 0
    for name, text in bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").toLocalIterator():
        words = ALNUM_WORD.findall((text or "").encode().lower())
        if held and size + len(words) > block_words:
            yield ItemAutomaton(held, window)
            held, size = [], 0
        held.append((name, words))
        size += len(words)
    yield ItemAutomaton(held, window)


FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("longest", T.LongType()), T.StructField("spans", T.BinaryType()), T.StructField("rest", T.StringType()),
    ]
)


def findings(n_words: list[int], spans: list, items: list, longest: list[int], text: pa.Array | None) -> pa.StructArray:
    """``FOUND`` of some documents; the spans are merged, and cut out where texts are given."""
    spans = [merged(x) for x in spans]
    rest = [None] * len(spans) if text is None else [without(t.as_py(), x) if x else None for t, x in zip(text, spans, strict=True)]
    columns = [
        pa.array(n_words, pa.int64()), pa.array([sum(e - s for s, e in x) for x in spans], pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())),
        pa.array(longest, pa.int64()), pa.array([np.array(x, np.int64).tobytes() for x in spans], pa.binary()), pa.array(rest, pa.string()),
    ]
    return pa.StructArray.from_arrays(columns, FOUND.names)


def finder(shared, cut: bool):
    """An Arrow function of a text: what one automaton finds in it (``FOUND``)."""

    @F.arrow_udf(FOUND)
    def found(text: pa.Array) -> pa.Array:
        automaton: ItemAutomaton = shared.value
        data, offsets = text_buffers(text)
        raw = data.tobytes()
        n_words, spans, items, longest = [], [], [], []
        for first, last, places, begins, ends, h in hashed_words(data, offsets, NOT_ALNUM):
            known = automaton.known(h)
            # runs of known words within a document
            start = known.copy()
            start[1:] &= ~known[:-1]
            start[places[:-1][places[:-1] < len(h)]] = known[places[:-1][places[:-1] < len(h)]]
            stop = known.copy()
            stop[:-1] &= ~known[1:]
            tail = places[1:] - 1
            tail = tail[tail >= 0]
            stop[tail] = known[tail]
            s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
            long = (e - s) >= max(automaton.least, 1)
            s, e = s[long], e[long]
            owner = np.searchsorted(places, s, "right") - 1
            hit: dict[int, tuple[list, set, int]] = {}
            for o, a, b in zip(owner.tolist(), s.tolist(), e.tolist(), strict=True):
                words = [raw[x:y].lower() for x, y in zip(begins[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                at, names, most = hit.get(o, ([], set(), 0))
                most = max(most, automaton.stream(words, a - int(places[o]), at, names))
                hit[o] = (at, names, most)
            for i in range(last - first):
                at, names, most = hit.get(i, ((), (), 0))
                n_words.append(int(places[i + 1] - places[i]))
                spans.append(at)
                items.append(names)
                longest.append(most)
        return findings(n_words, spans, items, longest, text if cut else None)

    return found


def gatherer(cut: bool):
    """An Arrow function of a text (null unless spans are cut) and of what several automata found in it: all of it together."""

    @F.arrow_udf(FOUND)
    def gathered(text: pa.Array, parts: pa.Array) -> pa.Array:
        rows = parts.to_pylist()
        spans = [[tuple(x) for f in row for x in np.frombuffer(f["spans"], np.int64).reshape(-1, 2).tolist()] for row in rows]
        items = [{x for f in row for x in f["items"]} for row in rows]
        return findings([max(f["n_words"] for f in row) for row in rows], spans, items, [max(f["longest"] for f in row) for row in rows], text if cut else None)

    return gathered


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with spans of its words cut out."""
    raw = text.encode()
    places = [m.span() for m in ALNUM_WORD.finditer(raw.lower())]
    for s, e in reversed(spans):
        raw = raw[: places[s][0]].rstrip() + b" " + raw[places[e - 1][1] :].lstrip()
    return raw.decode().strip()


def scan(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, cut: bool = False) -> tuple[DataFrame, str]:
    """``docs`` with what all items find in a struct column (``FOUND``), whose name is returned as well.

    With more items than one automaton takes, the documents are written once under a key; each automaton reads
    their texts and writes its findings only, and these, gathered by key, meet the documents again at the end.
    """
    context, (name, key) = docs.sparkSession.sparkContext, fresh(docs, "found", "key")
    automata, text = blocks(bench, window, block_words), F.col("text").cast("string")
    block, following = next(automata), next(automata, None)
    if following is None:
        return docs.withColumn(name, finder(context.broadcast(block), cut)(text)), name
    rows = stage(docs.withColumn(key, F.monotonically_increasing_id()), "decontaminate")
    parts = []
    for block in chain((block, following), automata):
        shared = context.broadcast(block)
        part = rows.select(key, finder(shared, False)(text).alias(name))
        # the first keeps every document for its number of words; none is held by the workers beside the next
        parts.append(stage(part if not parts else part.where(F.col(name)["longest"] > 0), "found"))
        shared.destroy()
    all_found = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.collect_list(name).alias(name))
    out = rows.join(all_found, key)
    return out.withColumn(name, gatherer(cut)(text if cut else F.lit(None).cast("string"), F.col(name))).drop(key), name


def over(found: Column, coverage: int = 20) -> Column:
    """The contamination rule: some hit, and hit words are at least 1/coverage of all."""
    return (found["n_hit"] > 0) & (found["n_hit"] * coverage >= found["n_words"])


def report(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: words, hit words, items, digest of the item ids, contaminated, longest match."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, name = scan(rows, bench, window, block_words)
    f = F.col(name)
    return rows.select(
        "doc_id", f["n_words"].alias("n_words"), f["n_hit"].alias("n_hit"), F.size(f["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(f["items"], ","), 256).alias("items_sha256"), over(f).alias("contaminated"), f["longest"].alias("longest_match"),
    )


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW, coverage: int = 20, cut: bool = True, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents under the coverage limit, with their columns; spans of window length or more cut out if ``cut``."""
    rows, name = scan(docs, bench, window, block_words, cut)
    kept = rows.where(~over(F.col(name), coverage))
    return kept.select(*(F.coalesce(F.col(name)["rest"], "text").alias(c) if cut and c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents over the coverage limit go; the others stay as they are, short hits included."""
    bounded_batches(spark)
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), cut=False)
