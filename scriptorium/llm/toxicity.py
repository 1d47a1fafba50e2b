"""Toxicity as ordinal severity: cumulative-link logistic regression on sparse words.

P(grade <= j) = logistic(theta_j - x w): one weight vector for all ordered
thresholds.  x holds log counts of the words, and of the first few bytes of
words, that set toxic and clean labelled documents apart.  Labels are grades, 0
(clean) and up; labels of 0 and 1 have one threshold, and no levels are made up
for them.  The model is fitted on a bounded sample (labelled documents whose ids
hash lowest, ``max_labelled``); every document is then scored, whole text, where
it lies, with its expected severity.

Defined cases: null text has no words; labels that repeat an id count once (the
highest), documents that repeat one count by the least of their features;
without toxic and clean labels nothing can be learned and all severities are 0;
an empty table has no rows; texts of any length are scored whole; further
columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_ALNUM, U64, hashed_words, mix, stage, text_buffers

MAX_LABELLED, FEATURES = 8000, 1024
#: Bytes of the beginnings of longer words that are features too.
STEMS = (4, 5, 6)
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of some texts at a time: first text, last text + 1, and of each word and beginning of a word its text and hash."""
    data, offsets = text_buffers(column)
    lower = np.concatenate([_LOWER[data], np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", lower, strides=(1,))
    for first, last, places, begins, ends, h in hashed_words(data, offsets, NOT_ALNUM):
        owner = np.repeat(np.arange(last - first), np.diff(places))
        owners, hashes = [owner], [h]
        for n in STEMS:
            longer = ends - begins > n
            with np.errstate(over="ignore"):
                hashes.append(mix((eight[begins[longer]] & U64((1 << 8 * n) - 1)) + U64(n << 56)))
            owners.append(owner[longer])
        yield first, last, np.concatenate(owners), np.concatenate(hashes)


def word_counts(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct feature hashes of each text and their counts."""
    out = []
    for first, last, owner, h in features(column):
        order = np.argsort(owner, kind="stable")
        ends = np.searchsorted(owner[order], np.arange(last - first + 1))
        h = h[order]
        out += [np.unique(h[ends[i] : ends[i + 1]], return_counts=True) for i in range(last - first)]
    return out


def _sample(batches):
    for batch in batches:
        got = word_counts(batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("grade"), pa.array([a.tobytes() for a, _ in got], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in got], pa.binary())],
            names=["doc_id", "grade", "words", "counts"],
        )


@dataclass
class Ordinal:
    """Chosen word hashes (ascending), weights and ordered thresholds."""

    words: np.ndarray
    weights: np.ndarray
    thetas: np.ndarray

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > j) for each threshold j."""
        return 1 / (1 + np.exp(np.clip(self.thetas[None, :] - z[:, None], -30, 30)))


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int, l2: float = 2e-4, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of the cumulative-link model by Adam; thresholds stay ordered by construction."""
    n, k = x.shape
    first = np.log(np.clip((y == 0).mean(), 1e-3, 1 - 1e-3) / np.clip((y > 0).mean(), 1e-3, 1))
    p = np.concatenate([np.zeros(k), [first], np.zeros(grades - 1)])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, gaps = p[:k], np.exp(p[k + 1 :])
        theta = np.concatenate([[-np.inf], p[k] + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        z = x @ w
        hi, lo = (1 / (1 + np.exp(-np.clip(theta[y + d] - z, -30, 30))) for d in (1, 0))
        hi, lo = np.where(y == grades, 1.0, hi), np.where(y == 0, 0.0, lo)
        mass = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi) / mass, lo * (1 - lo) / mass
        g_w = x.T @ (d_hi - d_lo) / n + l2 * w
        g_theta = np.array([(-d_hi[y == j].sum() + d_lo[y == j + 1].sum()) / n for j in range(grades)])
        g_gaps = np.array([g_theta[j:].sum() for j in range(1, grades)]) * gaps
        g = np.concatenate([g_w, [g_theta.sum()], g_gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:k], p[k] + np.concatenate([[0], np.cumsum(np.exp(p[k + 1 :]))])


def choose(hashes: list[np.ndarray], toxic: np.ndarray, features: int) -> np.ndarray:
    """Words with the largest evidence either way (ascending hash)."""
    every, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    owner = np.repeat(toxic, [len(h) for h in hashes])
    pos = np.bincount(inverse, owner, len(every))
    neg = np.bincount(inverse, ~owner, len(every))
    a, b = toxic.sum(), (~toxic).sum()
    odds = np.log((pos + 0.5) / (a - pos + 0.5)) - np.log((neg + 0.5) / (b - neg + 0.5))
    strength = np.abs(odds) / np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5)) * (pos + neg >= 3)
    return every[np.sort(np.argsort(-strength, kind="stable")[:features])]


def counts_of(rows: list[tuple[np.ndarray, np.ndarray]], words: np.ndarray) -> np.ndarray:
    """Log counts of the chosen words in each document."""
    x = np.zeros((len(rows), len(words)), np.float32)
    for i, (h, c) in enumerate(rows):
        at = np.minimum(np.searchsorted(words, h), len(words) - 1)
        ok = words[at] == h
        x[i, at[ok]] = np.log1p(c[ok])
    return x


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_labelled: int = MAX_LABELLED, features: int = FEATURES) -> Ordinal | None:
    """Fit on the grades in ``label``, 0 and up; negative ones count as 0."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("grade"))
    known = stage(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled), "sample")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    found = rows.select("doc_id", "grade", "text").mapInArrow(_sample, "doc_id long, grade int, words binary, counts binary")
    found = found.groupBy("doc_id", "grade").agg(F.min(F.struct("words", "counts")).alias("f")).select("doc_id", "grade", "f.words", "f.counts")
    got = found.toArrow().sort_by("doc_id")
    y = np.maximum(got.column("grade").to_numpy().astype(np.int64), 0) if got.num_rows else np.zeros(0, np.int64)
    if len(np.unique(y > 0)) < 2:
        return None
    sparse = [(np.frombuffer(a, U64), np.frombuffer(c, np.int32)) for a, c in zip(got.column("words").to_pylist(), got.column("counts").to_pylist(), strict=True)]
    words = choose([h for h, _ in sparse], y > 0, features)
    weights, thetas = fit_ordinal(counts_of(sparse, words).astype(np.float64), y, int(y.max()))
    return Ordinal(words, weights, thetas)


def scorer(model: Ordinal | None):
    def run(batches):
        for batch in batches:
            z = np.zeros(batch.num_rows)
            if model is None:
                above = np.zeros((batch.num_rows, 1))
            else:
                low = np.zeros(1 << 16, bool)
                low[(model.words & U64(0xFFFF)).astype(np.int64)] = True
                for first, last, owners, h in features(batch.column("text")):
                    at = np.flatnonzero(low[(h & U64(0xFFFF)).astype(np.int64)])
                    place = np.minimum(np.searchsorted(model.words, h[at]), len(model.words) - 1)
                    ok = model.words[place] == h[at]
                    owner, place = owners[at[ok]], place[ok]
                    pair, n = np.unique(owner * len(model.words) + place, return_counts=True)
                    z[first:last] = np.bincount(pair // len(model.words), np.log1p(n) * model.weights[pair % len(model.words)], last - first)
                above = model.above(z)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(above[:, 0] >= 0.5)],
                names=["doc_id", "severity", "p_toxic", "toxic"],
            )

    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, severity (expected grade: the sum of P(grade > j)), p_toxic (grade over 0) and toxic (p_toxic of a half or more)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scorer(train(docs, labels)), "doc_id long, severity double, p_toxic double, toxic boolean")
