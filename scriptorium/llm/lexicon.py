"""BPE encoding and decoding through a minimal acyclic transducer.

The most frequent words of the corpus are compiled into a minimal acyclic
automaton: equal suffixes share states, and the numbers on a word's arcs add up
to its rank, which points at its ids.  The automaton is flat arrays in one file
that Spark hands to every executor, where workers map it into memory and look
up all words that a worker has not met before at once, a letter a step.  Words
that it does not hold are merged exactly by the ranks of the file.  Only texts
that hold the string of a special token are encoded by the library as a whole.

Defined cases: null text is empty and has no ids; repeated rows and ids are
coded row by row; an empty table gives no rows (and an empty lexicon); texts of
any length are coded whole; further columns take no part.
"""

from __future__ import annotations

import hashlib
import io
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, new_path, release_memory, stage, tokenizer_path
from .pieces import Encoder, PieceTable, Splitter, groups, load, merges

#: Words in the lexicon, and the longest it takes (bytes); both bound the file.
WORDS, LONGEST = 32_768, 32


def minimal(words: list[bytes]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of sorted distinct words (incremental construction).

    ``key`` holds state * 256 + letter of each arc, ascending; ``to`` its state; ``add`` the words
    that come before it at its state; ``final`` marks states.
    """
    register: dict[tuple, int] = {}
    finals: list[bool] = []
    arcs: list[dict[int, int]] = []

    def new() -> int:
        finals.append(False), arcs.append({})
        return len(arcs) - 1

    root, last = new(), b""
    path = [root]

    def fold(depth: int) -> None:
        while len(path) > depth + 1:
            state = path.pop()
            same = register.setdefault((finals[state], tuple(arcs[state].items())), state)
            arcs[path[-1]][last[len(path) - 1]] = same

    for word in words:
        k = 0
        while k < min(len(word), len(last)) and word[k] == last[k]:
            k += 1
        fold(k)
        for letter in word[k:]:
            state = new()
            arcs[path[-1]][letter] = state
            path.append(state)
        finals[path[-1]] = True
        last = word
    fold(0)
    number, order, stack = {}, [], [root]
    while stack:
        s = stack.pop()
        if s not in number:
            number[s] = len(order)
            order.append(s)
            stack.extend(arcs[s].values())
    below: dict[int, int] = {}

    def count(s: int) -> int:
        todo = [s]
        while todo:
            x = todo[-1]
            missing = [y for y in arcs[x].values() if y not in below]
            if missing:
                todo.extend(missing)
            else:
                below[x] = finals[x] + sum(below[y] for y in arcs[x].values())
                todo.pop()
        return below[s]

    count(root)
    key, to, add = [], [], []
    for s in order:
        before = int(finals[s])
        for letter in sorted(arcs[s]):
            t = arcs[s][letter]
            key.append(number[s] * 256 + letter), to.append(number[t]), add.append(before)
            before += below[t]
    return {"key": np.array(key, np.int64), "to": np.array(to, np.int32), "add": np.array(add, np.int32), "final": np.array([finals[s] for s in order])}


def pack(words: list[bytes], ids: list[list[int]]) -> bytes:
    """The lexicon as one uncompressed archive; ``words`` sorted, ``ids`` of each."""
    out = io.BytesIO()
    arrays = minimal(words) | {"start": np.cumsum([0, *map(len, ids)]).astype(np.int32), "ids": np.array(list(chain.from_iterable(ids)), np.int32)}
    heads = "\n".join(f"{k} {v.dtype.str} {len(v)}" for k, v in arrays.items()).encode()
    out.write(len(heads).to_bytes(8, "little") + heads + b" " * (-len(heads) % 8))
    for v in arrays.values():
        out.write(v.tobytes() + b"\0" * (-v.nbytes % 8))
    return out.getvalue()


class Lexicon:
    """A packed lexicon, mapped from its file."""

    def __init__(self, path: str) -> None:
        raw = np.memmap(path, np.uint8, "r")
        size = int(raw[:8].view(np.int64)[0])
        at = 8 + size + -size % 8
        for line in raw[8 : 8 + size].tobytes().decode().split("\n"):
            name, kind, n = line.split()
            nbytes = np.dtype(kind).itemsize * int(n)
            setattr(self, name, raw[at : at + nbytes].view(kind))
            at += nbytes + -nbytes % 8

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word, -1 for unknown ones; all words step together."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        out = np.full(len(words), -1, np.int64)
        if not len(self.key) or not words:
            return out
        short = np.flatnonzero((size > 0) & (size <= LONGEST))
        short = short[np.argsort(-size[short], kind="stable")]
        data = np.frombuffer(b"".join(words), np.uint8)
        begin, left = (np.cumsum(size) - size)[short], size[short]
        state, rank, alive = np.zeros(len(short), np.int64), np.zeros(len(short), np.int64), np.ones(len(short), bool)
        for i in range(int(left[0]) if len(left) else 0):
            n = int(np.searchsorted(-left, -i, "left"))
            at = np.flatnonzero(alive[:n])
            want = state[at] * 256 + data[begin[at] + i]
            arc = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            ok = self.key[arc] == want
            alive[at[~ok]] = False
            at, arc = at[ok], arc[ok]
            state[at] = self.to[arc]
            rank[at] += self.add[arc]
        alive &= self.final[state]
        out[short[alive]] = rank[alive]
        return out

    def ids_of(self, rank: int) -> np.ndarray:
        return self.ids[self.start[rank] : self.start[rank + 1]]


class WordEncoder(Encoder):
    """Ids of texts as ``encode(text, add_special_tokens=False)`` gives them, and back."""

    def __init__(self, path: str, lexicon: Lexicon | None = None) -> None:
        library = load(path)
        super().__init__(library, True, "<i4", self.looked_up)
        self.lexicon, self.merge = lexicon, merges(library)
        self.tokens = [library.id_to_token(i) or "" for i in range(library.get_vocab_size())]

    def looked_up(self, words: list[bytes], dtype: str) -> list[np.ndarray]:
        """Ids of words: from the lexicon, of the others merged."""
        ranks = self.lexicon.ranks(words) if self.lexicon else np.full(len(words), -1)
        out = [self.lexicon.ids_of(r) if r >= 0 else None for r in ranks.tolist()]
        unseen = np.flatnonzero(ranks < 0).tolist()
        for i, ids in zip(unseen, self.merge([words[i] for i in unseen], dtype), strict=True):
            out[i] = ids
        return out

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The tokens of the ids, special ones too; the file has no decoder, so a space parts them."""
        return " ".join(map(self.tokens.__getitem__, ids))


_held: dict[tuple[str, str | None], WordEncoder] = {}


def word_encoder(path: str, file: str | None = None) -> WordEncoder:
    """One encoder a worker process; ``file`` is the name under which Spark sent the lexicon."""
    if (path, file) not in _held:
        _held.clear()
        _held[path, file] = WordEncoder(path, Lexicon(SparkFiles.get(file)) if file else None)
    return _held[path, file]


def _count(path: str):
    """text -> words of at most ``LONGEST`` bytes and how often this task met them since it last handed them on."""

    def run(batches):
        release_memory()
        split, table, names = Splitter(load(path), True), PieceTable(), []
        total = np.zeros(1 << 16, np.int64)

        def out():
            used = np.flatnonzero(total)
            for at in range(0, len(used), 1 << 15):
                some = used[at : at + (1 << 15)]
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in some.tolist()], pa.binary()).cast(pa.string()), pa.array(total[some], pa.int64())], names=["word", "n"])

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for first, last in groups(texts):
                data, begin, end, _ = split.split([split.plain(t) or "" for t in texts[first:last]])
                fits = end - begin <= LONGEST  # longer ones enter no lexicon
                begin, end = begin[fits], end[fits]
                numbers, new = table.numbers(data, begin, end)
                names += new
                while len(total) < len(names):
                    total = np.concatenate([total, np.zeros_like(total)])
                total += np.bincount(numbers, minlength=len(total))
                if table.full:
                    yield from out()
                    table.clear()
                    names, total = [], np.zeros(1 << 16, np.int64)
        yield from out()

    return run


def _level(n):
    """Counts up to 1,024 as they are, larger ones in 64 steps a doubling."""
    return F.when(n <= 1024, n).otherwise(F.lit(1024) + F.floor((F.log2(n) - 10) * 64)).cast("int")


def upto(sizes: list[tuple[int, int]], room: int) -> tuple[int | None, int]:
    """The last key of (key, size) that still fits, and the room that is left."""
    last = None
    for key, size in sizes:
        if size > room:
            break
        last, room = key, room - size
    return last, room


def compile_lexicon(docs: DataFrame, path: str, words: int = WORDS) -> str:
    """Count the words of all documents, compile the most frequent, and send the file to the executors.

    A histogram of the counts tells which words are frequent enough; of those at the limit, which do not all fit,
    the ones whose hashes are least are taken, by a second histogram.  Only the histograms, of a few thousand and
    65,536 rows at most whatever the corpus, and the chosen words reach the driver.
    """
    spark = docs.sparkSession
    counts = docs.select("text").mapInArrow(_count(path), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = counts.where(F.octet_length("word") <= LONGEST).select("word", _level(F.col("n")).alias("level"), F.pmod(F.xxhash64("word"), F.lit(1 << 16)).cast("int").alias("hash"))
    counts = stage(counts, "words")
    levels = sorted(map(tuple, counts.groupBy("level").count().collect()), reverse=True)  # bounded
    least, room = upto(levels, words)
    taken = F.lit(False) if least is None else F.col("level") >= least
    limit = next((x for x, _ in levels if least is None or x < least), None)
    if limit is not None and room:
        hashes = counts.where(F.col("level") == limit).groupBy("hash").count().collect()  # bounded
        last, _ = upto(sorted(map(tuple, hashes)), room)
        if last is not None:
            taken = taken | (F.col("level") == limit) & (F.col("hash") <= last)
    chosen = sorted(r.word.encode() for r in counts.where(taken).select("word").collect())  # at most ``words``
    encoder = word_encoder(path)
    return send(spark, pack(chosen, [x.tolist() for x in encoder.merge(chosen, "<i4")]))


def send(spark: SparkSession, data: bytes) -> str:
    """Write a file to the shared folder and let Spark hand it to every executor."""
    place = new_path(spark, "lexicon")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(place)
    return place.rsplit("/", 1)[-1]


def _digest(path: str, file: str):
    def run(batches):
        release_memory()
        encoder = word_encoder(path, file)
        numbers = [str(i) for i in range(len(encoder.tokens))]
        for batch in batches:
            ids = [x.tolist() for x in encoder.arrays(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(" ".join(map(numbers.__getitem__, x)).encode()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(encoder.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _encode(path: str, file: str):
    def run(batches):
        encoder = word_encoder(path, file)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(encoder.arrays(batch.column("text").to_pylist())), pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches):
        encoder = word_encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([encoder.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def encode(docs: DataFrame, tokenizer: str | None = None, words: int = WORDS) -> DataFrame:
    """doc_id and ids of every document."""
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    return _rows(docs).mapInArrow(_encode(path, compile_lexicon(docs, path, words)), "doc_id long, ids array<int>")


def decode(coded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and decoded text of encoded documents."""
    return coded.select("doc_id", "ids").mapInArrow(_decode(tokenizer or tokenizer_path("word_bpe_49k.json")), "doc_id long, text string")


def digests(docs: DataFrame, tokenizer: str | None = None, words: int = WORDS) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the decoded text."""
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    file = compile_lexicon(docs, path, words)
    return _rows(docs).mapInArrow(_digest(path, file), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the digests of what the stages before kept."""
    bounded_batches(spark)
    return digests(docs)
