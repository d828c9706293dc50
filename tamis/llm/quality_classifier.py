"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - z), with one weight per bucket of hashed byte 3-grams shared by all thresholds,
z = the weights times the text's TF-IDF vector of unit length (log counts; document frequencies over all documents),
and thresholds kept in order by their exponentiated gaps. It is fitted on a bounded sample of rated documents (SAMPLE
documents and SAMPLE_GRAMS distinct grams at most, chosen by hash; the bounds are parameters) in one task, which gets
features, not texts; every document is then scored where it is read. Expected grade = sum of the tails; the tail of the
highest grade selects.

Defined results: a null or empty text has no grams, so z = 0; a document without a rating is scored like any other; a
doc_id with several ratings has the highest, one with several texts is fitted on the one of least hash; with fewer than
two grades in the sample nothing can be fitted, and every tail is 1; repeated rows are scored each.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, table
from .grams import BITS, hashed, pieces

WIDTH = 3
SAMPLE = 6000
SAMPLE_GRAMS = 12_000_000
EPOCHS = 12


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    lowest: int
    idf: np.ndarray | None = None

    def tails(self, z: np.ndarray) -> np.ndarray:
        """(rows, thresholds): P(grade > k)."""
        if not len(self.thresholds):
            return np.ones((len(z), 1))
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -50, 50)))


def fit_arrays(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, epochs: int = EPOCHS, rate: float = 40.0, decay: float = 1e-6) -> Model:
    """rows: (buckets, their values) of each document. Gradient descent over batches of 32 in a fixed order."""
    kinds = np.unique(grades)
    weights = np.zeros(1 << BITS)
    if len(kinds) < 2:
        return Model(weights.astype(np.float32), np.zeros(0), int(kinds[0]) if len(kinds) else 0)
    y = np.searchsorted(kinds, grades)
    below = np.array([(y <= k).mean() for k in range(len(kinds) - 1)])
    start = np.log(below / (1 - below))
    base, gaps = start[0], np.log(np.maximum(np.diff(start), 1e-3))
    ts = np.full(len(start), 1e-2)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 32)):
            at = np.concatenate([rows[i][0] for i in batch])
            x = np.concatenate([rows[i][1] for i in batch])
            who = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
            z = np.bincount(who, weights[at] * x, len(batch))
            cut = base + np.r_[0, np.cumsum(np.exp(gaps))]
            p = np.c_[np.zeros(len(batch)), 1 / (1 + np.exp(np.clip(z[:, None] - cut, -50, 50))), np.ones(len(batch))]
            k, r = y[batch], np.arange(len(batch))
            high, low = p[r, k + 1], p[r, k]
            mass = np.maximum(high - low, 1e-9)
            dh, dl = high * (1 - high) / mass, low * (1 - low) / mass
            g = np.bincount(at, ((dh - dl) / len(batch))[who] * x, 1 << BITS)  # of the loss by the weights
            used = np.unique(at)
            weights[used] -= rate * (g[used] + decay * weights[used])
            dcut = np.zeros(len(start) + 2)
            np.add.at(dcut, k + 1, -dh / len(batch))
            np.add.at(dcut, k, dl / len(batch))
            dcut = dcut[1:-1]
            gt = np.r_[dcut.sum(), [dcut[j + 1 :].sum() * np.exp(gaps[j]) for j in range(len(gaps))]]
            ts += gt**2
            move = 0.1 * gt / np.sqrt(ts)
            base, gaps = base - move[0], gaps - move[1:]
    return Model(weights.astype(np.float32), base + np.r_[0, np.cumsum(np.exp(gaps))], int(kinds[0]))


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Inverse document frequencies of the buckets over all docs; at most 2^18 rows come to the driver."""

    def run(batches):
        df, n = np.zeros(1 << BITS, np.int64), 0
        for b in batches:
            for part in pieces(b, 0):
                n += part.num_rows
                for at, _ in features(part.column(0)):
                    df[at] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[n, df[at]])], names=["bucket", "n"])

    got = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = got["bucket"].to_numpy(), got["n"].to_numpy()
    df = np.zeros(1 << BITS)
    df[bucket[bucket >= 0]] = n[bucket >= 0]
    return np.log((n[bucket < 0].sum() + 1) / (df + 1)).astype(np.float32) + np.float32(1e-3)


def features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets, log(1 + count)) of each text."""
    buckets, first = hashed(texts, WIDTH)
    if len(buckets):  # all texts at once: a text's buckets lie side by side, in order
        code = np.sort(np.repeat(np.arange(len(first) - 1, dtype=np.int64) << BITS, np.diff(first)) | buckets)
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        n = np.diff(np.r_[starts, len(code)])
        at, ends = (code[starts] & (1 << BITS) - 1).astype(np.int32), np.searchsorted(starts, first)
        value = np.log1p(n).astype(np.float32)
    else:
        at, value, ends = np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(len(first), np.int64)
    return [(at[a:b], value[a:b]) for a, b in zip(ends, ends[1:])]


def normed(at: np.ndarray, value: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = value * idf[at]
    return x / np.maximum(np.sqrt((x * x).sum()), 1e-9)


def fit(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, sample_grams: int = SAMPLE_GRAMS) -> Model:
    """ratings: doc_id, grade (int). The `sample` ratings of least hash meet their texts by a broadcast of that many ids."""
    idf = document_frequencies(docs)
    rated = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    chosen = bounded_sample(rated, F.col("doc_id"), sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", F.xxhash64("text").alias("h"), "text")

    def made(batches):
        for b in batches:
            for part in pieces(b, 3):
                found = features(part.column(3))
                packed = [pa.array([x[k].tobytes() for x in found], pa.binary()) for k in (0, 1)]
                sizes = pa.array([len(x[0]) for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *packed, sizes], names=["doc_id", "grade", "h", "at", "value", "size"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInArrow(made, f"doc_id {kind}, grade int, h long, at binary, value binary, size long")
    # one text for each id; a hash decides, so the sum is partial before the shuffle
    rows = table(rows.groupBy("doc_id", "grade").agg(F.min_by(F.struct("at", "value", "size"), F.struct("h", "size")).alias("x")).select("doc_id", "grade", "x.*"))
    rows = bounded_sample(rows, F.col("doc_id"), sample_grams, F.col("size"))

    def run(batches):
        own, grades = [], []
        for b in batches:
            grades += b.column(0).to_pylist()
            for at, value in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                at = np.frombuffer(at, np.int32)
                own.append((at, normed(at, np.frombuffer(value, np.float32), idf)))
        model = fit_arrays(own, np.array(grades, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    one = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("grade", "at", "value")
    (found,) = one.mapInArrow(run, "model binary").collect() or (None,)
    model = pickle.loads(found.model) if found else fit_arrays([], np.zeros(0, np.int64))
    model.idf = idf
    return model


def score(docs: DataFrame, model: Model, least_tail: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail (probability of the highest grade) and kept (tail >= least_tail)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB: 2^18 weights and frequencies

    def run(batches):
        m = shared.value
        for b in batches:
            for part in pieces(b, 1):
                z = np.array([float(m.weights[at] @ normed(at, value, m.idf)) for at, value in features(part.column(1))])
                tails = m.tails(z)
                cols = [part.column(0), pa.array(m.lowest + (tails.sum(1) if len(m.thresholds) else 0 * tails[:, 0])), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= least_tail)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "expected_grade", "tail", "kept"])

    own = docs.select("doc_id", "text")
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, expected_grade double, tail double, kept boolean")
