"""Quality classification by co-training.

Two views of a document, each with a logistic model: its content (byte
histogram, word statistics) and its page metadata (language, source, length).
Each round every model labels all unlabelled documents and hands those it is
surest of to the other; afterwards each is calibrated on labelled rows that it
was not trained on, and the calibrated log-odds are added.

Only the labelled rows are a bounded sample, the documents whose ids hash lowest
(``max_labelled``); documents with other labels count as unlabelled.  Their
features are written once.  A histogram of all scores sets how sure a label must
be, and what is learned from the labels comes as sums of gradients and Hessians
over all of them; no rows are gathered.  A pseudo-label weighs so much that all
unlabelled documents together weigh no more than the labelled rows.

Defined cases: null text is empty; null metadata is a value of its own; labels
that repeat an id count once (the lowest), unlabelled rows that repeat one count
each, of labelled rows that repeat one that with the least features counts;
without labels of both classes nothing can be learned, all scores are 0.5 and
all documents are kept; further columns, whatever their names, stay as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, bounded_batches, hashed_words, rows_of, stage, text_buffers

MAX_LABELLED, ROUNDS, KEEP_AT = 6000, 3, 0.5
TEXT_DIM, META_DIM = 256 + 6, 32 + 128 + 3


def text_view(column: pa.Array) -> np.ndarray:
    """Content features: root byte frequencies, and how words repeat."""
    data, offsets = text_buffers(column)
    out = np.zeros((len(column), TEXT_DIM), np.float32)
    for first, last, places, begins, ends, h in hashed_words(data, offsets, WHITE):
        for i in range(first, last):
            b = data[offsets[i] : offsets[i + 1]]
            w = h[places[i - first] : places[i - first + 1]]
            n = max(len(w), 1)
            out[i, :256] = np.sqrt(np.bincount(b, minlength=256) / max(len(b), 1))
            s = np.sort(w)
            runs = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]])) if len(s) else np.array([0, 0])
            size = ends[places[i - first] : places[i - first + 1]] - begins[places[i - first] : places[i - first + 1]]
            out[i, 256:] = (
                np.log1p(len(w)) / 8, (len(runs) - 1) / n, np.diff(runs).max(initial=0) / n,
                (w[1:] == w[:-1]).mean() if len(w) > 1 else 0, np.log1p(size.mean()) / 3 if len(w) else 0, 1.0,
            )
    return out


def meta_view(lang: list, source: list, n_chars: list) -> np.ndarray:
    """Metadata features: hashed language and source, and the stated length."""
    out = np.zeros((len(lang), META_DIM), np.float32)
    for i, (a, b, n) in enumerate(zip(lang, source, n_chars, strict=True)):
        out[i, zlib.crc32(str(a).encode()) % 32] = 1
        out[i, 32 + zlib.crc32(str(b).encode()) % 128] = 1
        out[i, 160:] = (np.log1p(max(n or 0, 0)) / 8, n is None, 1)
    return out


def views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return text_view(batch.column("text")), meta_view(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")))


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 12) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w, eye = np.zeros(x.shape[1]), l2 * np.eye(x.shape[1])
    x = x.astype(np.float64)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + eye, x.T @ (p - y) + l2 * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class CoTrained:
    """Weights of both views, their calibration (slope, shift) and the prior log-odds."""

    text: np.ndarray
    meta: np.ndarray
    text_cal: tuple[float, float]
    meta_cal: tuple[float, float]
    prior: float

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality by text, by metadata, and by both."""
        a = text @ self.text * self.text_cal[0] + self.text_cal[1]
        b = meta @ self.meta * self.meta_cal[0] + self.meta_cal[1]
        return tuple(1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (a, b, a + b - self.prior))


#: Scores are counted in bins of 1/64 log-odds from -32 to 32; a teacher is sure below -SURE and above SURE.
BINS_A_UNIT, SPAN, SURE = 64, 32, 2
PIECES = 8


@dataclass
class Round:
    """What both views taught in a round: weights, and per class the bin of the last taught and the share taken of it."""

    weights: tuple[np.ndarray, np.ndarray]
    bad: list[tuple[int, float]]
    good: list[tuple[int, float]]


def binned(z: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((z + SPAN) * BINS_A_UNIT), 0, 2 * SPAN * BINS_A_UNIT - 1).astype(np.int64)


def last_taught(counts: np.ndarray, few: float) -> tuple[int, float]:
    """The bin in which the first ``few`` documents end, and the share of its documents that is still taken."""
    upto = np.cumsum(counts)
    at = int(np.searchsorted(upto, few))
    if at == len(counts):
        return at, 1.0
    return at, float((few - (upto[at] - counts[at])) / counts[at]) if counts[at] else 0.0


def cuts(counts: np.ndarray, few: float, share: float) -> tuple[tuple[int, float], tuple[int, float]]:
    """Ends of the surest bad and good documents of a histogram; only labels that the teacher is sure of."""
    low, high = (SPAN - SURE) * BINS_A_UNIT, (SPAN + SURE) * BINS_A_UNIT
    bad, rest = last_taught(counts[:low], few * (1 - share))
    good, left = last_taught(counts[high:][::-1], few * share)
    return (bad, rest), (len(counts) - 1 - good, left)


def taught(both: tuple[np.ndarray, np.ndarray], rounds: list[Round]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows are still in the pool, and the weights (bad, good) that each view was taught for every row.

    Documents of the last bin are all taken with the share of it, so that equal scores count alike; they stay in the pool.
    """
    pool = np.ones(len(both[0]), bool)
    out = [np.zeros((len(pool), 2)) for _ in range(2)]
    for r in rounds:
        left = pool.copy()
        for v in range(2):
            at = binned(both[v] @ r.weights[v])
            for c, (beyond, (last, part)) in enumerate(((at < r.bad[v][0], r.bad[v]), (at > r.good[v][0], r.good[v]))):
                out[1 - v][:, c] += pool * (beyond + part * (at == last))
                left &= ~beyond
        pool = left
    return pool, out


def corpus_sums(features: DataFrame, rounds: list[Round], at: tuple[np.ndarray, np.ndarray], counting: bool = False) -> np.ndarray:
    """Over all unlabelled documents: gradients and Hessians of both views at weights ``at``, or histograms of the pool's scores.

    Tasks add up locally; pieces of their sums are added in Spark, the driver gets one vector.
    """
    n = 4 * SPAN * BINS_A_UNIT if counting else sum(d * (d + 1) for d in (TEXT_DIM, META_DIM))
    per = -(-n // PIECES)

    def add(batches):
        total = np.zeros(per * PIECES)
        for batch in batches:
            both = unpacked(batch)
            if counting:
                pool = taught(both, rounds)[0]
                for v in range(2):
                    total[v * n // 2 : (v + 1) * n // 2] += np.bincount(binned(both[v][pool] @ at[v]), minlength=n // 2)
                continue
            first = 0
            for x, w, own in zip(both, at, taught(both, rounds)[1], strict=True):
                some = own.any(1)
                x, (bad, good), d = x[some].astype(np.float64), own[some].T, x.shape[1]
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                total[first : first + d] += x.T @ (bad * p - good * (1 - p))
                total[first + d : first + d + d * d] += ((x * ((bad + good) * p * (1 - p))[:, None]).T @ x).ravel()
                first += d + d * d
        part = TaskContext.get().partitionId()
        pieces = [zlib.compress(total[c * per : (c + 1) * per].tobytes(), 1) for c in range(PIECES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([part] * PIECES, pa.int32()), pa.array(pieces, pa.binary())], names=["piece", "part", "sums"])

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, x in rows_of(batch, "piece", "sums"):
                sums[c] = sums.get(c, 0) + np.frombuffer(zlib.decompress(x))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([0] * len(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["piece", "part", "sums"])

    schema, out = "piece int, part int, sums binary", np.zeros(per * PIECES)
    unlabelled = features.where("quality is null").select("text_view", "meta_view")
    # in the order of the tasks, so that sums do not depend on which ends first
    pieces = unlabelled.mapInArrow(add, schema).repartition(PIECES, "piece").sortWithinPartitions("piece", "part")
    for row in pieces.mapInArrow(merge, schema).collect():  # one vector of a fixed size
        out[row.piece * per : (row.piece + 1) * per] = np.frombuffer(row.sums)
    return out[:n]


def refit(features: DataFrame, both: tuple[np.ndarray, np.ndarray], y: np.ndarray, rounds: list[Round], weight: float, l2: float = 1.0, steps: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Newton steps of both views from the last weights.

    The loss of labelled rows is exact; that of all the corpus was taught is taken to second order around the last
    weights, so that a round reads the features once.
    """
    sums, first, out = corpus_sums(features, rounds, rounds[-1].weights), 0, []
    for x, start in zip(both, rounds[-1].weights, strict=True):
        x, d, w = x.astype(np.float64), x.shape[1], start
        slope, bend = sums[first : first + d], sums[first + d : first + d + d * d].reshape(d, d)
        first += d + d * d
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            down = x.T @ (p - y) + l2 * w + weight * (slope + bend @ (w - start))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(d) + weight * bend, down)
            w = w - step
            if np.abs(step).max() < 1e-6:
                break
        out.append(w)
    return out[0], out[1]


def co_train(features: DataFrame, text: np.ndarray, meta: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, per_round: float = 0.1) -> CoTrained | None:
    """Fit on labelled rows (y: 1 good, 0 bad) and on all documents of ``features`` without a label.

    Every fifth labelled row is held out for calibration.
    """
    held = np.arange(len(y))[::5]
    train = np.setdiff1d(np.arange(len(y)), held)
    if len(np.unique(y[train])) < 2 or len(np.unique(y[held])) < 2:
        return None
    both, share = (text[train], meta[train]), y[train].mean()
    models = tuple(fit(x, y[train].astype(float)) for x in both)
    done: list[Round] = []
    weight = 1.0
    for r in range(rounds):
        counts = corpus_sums(features, done, models, counting=True).reshape(2, -1)
        if not counts.any():
            break
        if r == 0:
            # all documents together weigh no more than the labelled ones
            weight = min(1.0, len(train) / counts[0].sum())
        ends = [cuts(c, per_round * c.sum(), share) for c in counts]
        done.append(Round(models, [e[0] for e in ends], [e[1] for e in ends]))
        models = refit(features, both, y[train], done, weight)
    cal = []
    for x, w in zip((text, meta), models, strict=True):
        z = x[held] @ w
        cal.append(tuple(fit(np.stack([z, np.ones(len(z))], 1), y[held].astype(float), l2=1e-2)))
    share = y.mean()
    return CoTrained(models[0], models[1], cal[0], cal[1], float(np.log(share / (1 - share))))


FEATURES = "doc_id long, quality int, text_view binary, meta_view binary"


def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [pa.array([x.tobytes() for x in view], pa.binary()) for view in views(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), *packed], names=["doc_id", "quality", "text_view", "meta_view"])


def unpacked(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(b"".join(rows.column(c).to_pylist()), np.float32).reshape(rows.num_rows, d) for c, d in (("text_view", TEXT_DIM), ("meta_view", META_DIM)))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> CoTrained | None:
    """Fit on a bounded sample of the labels, whose features reach the driver, and on all other documents where they lie."""
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    known = stage(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled), "sample")
    if known.isEmpty():
        return None
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))
        .join(F.broadcast(known), "doc_id", "left")
    )
    features = stage(rows.mapInArrow(featured, FEATURES), "features")
    # of labelled rows that repeat an id that with the least features, so that the model does not depend on their order
    got = features.where("quality is not null").groupBy("doc_id", "quality").agg(F.min(F.struct("text_view", "meta_view")).alias("v"))
    got = got.select("doc_id", "quality", "v.text_view", "v.meta_view").toArrow().sort_by("doc_id")
    if not got.num_rows:
        return None
    return co_train(features, *unpacked(got), np.array([int(q > 0) for q in got.column("quality").to_pylist()]))


SCORES = T.StructType([T.StructField(c, T.DoubleType()) for c in ("p_text", "p_meta", "score")])


def scored(docs: DataFrame, model: CoTrained | None) -> Column:
    """The three probabilities of a row as a struct; only the columns that are looked at go through Python."""

    @F.arrow_udf(SCORES)
    def probabilities(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        if model is None:
            found = [np.full(len(text), 0.5)] * 3
        else:
            found = model.score(text_view(text), meta_view(lang.to_pylist(), source.to_pylist(), n_chars.to_pylist()))
        return pa.StructArray.from_arrays([pa.array(np.asarray(x, np.float64)) for x in found], SCORES.names)

    return probabilities(docs["text"].cast("string"), docs["lang"].cast("string"), docs["source"].cast("string"), docs["n_chars"].cast("long"))


def quality(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, p_text, p_meta, score and keep for every document."""
    out = docs.select(docs["doc_id"].cast("long").alias("doc_id"), scored(docs, train(docs, labels)).alias("s"))
    return out.select("doc_id", "s.p_text", "s.p_meta", "s.score", (F.col("s.score") >= keep_at).alias("keep"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that are more likely bad than good go."""
    bounded_batches(spark)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(scored(docs, model)["score"] >= KEEP_AT)
