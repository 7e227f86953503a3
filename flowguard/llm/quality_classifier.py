"""Quality: random-indexing word vectors, pooled per document, and a two-layer network.

Words are hashed into ``BUCKETS`` buckets, whatever the size of the vocabulary. Each bucket has a fixed sparse index vector of a few
+1 and -1; its word vector is the sum, over all its occurrences in the whole corpus, of the index
vectors of the words around it. These are sums of whole numbers, added up per task and then
across tasks, so they don't depend on how the corpus is split. A document is pooled into the
mean and the spread of its word vectors, its length and its share of distinct words. The network
is fitted on the driver on a bounded sample of labelled rows (``per_class`` of each class, by
the hash of their id), and its probabilities are calibrated by a temperature on rows set aside.

Defined cases: a null or empty text pools to zeros and is scored like any other; a null id is
kept as null; repeated rows give repeated results; without labels of both classes every score is
the share of good labels (0 if there are none); an empty table gives an empty result. Other
columns are neither read nor returned.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from flowguard.llm.common import blocks, fold, labelled_sample, texts
from flowguard.llm.words import ODD, mix

TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Sizes of the word table: 2^15 vectors of 32 numbers, 4 MB where it is sent to tasks.
BUCKETS, DIMS, NONZERO, REACH = 1 << 15, 32, 4, 2


class Bucketer:
    """Buckets of tokens; those seen are looked up, up to ``remember`` of them."""

    def __init__(self, remember: int = 200_000):
        self.seen: dict[str, int] = {}
        self.remember = remember

    def texts(self, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the tokens of all texts in turn, and for each text how many."""
        seen = self.seen
        if len(seen) > self.remember:
            seen.clear()
        split = [TOKEN.findall(t) for t in values]
        fresh = set()
        for words in split:
            fresh.update(words)
        for w in fresh.difference(seen):
            seen[w] = xxhash.xxh3_64_intdigest(w.encode()) % BUCKETS
        counts = np.fromiter(map(len, split), np.int64, len(split))
        flat = map(seen.__getitem__, chain.from_iterable(split))
        return np.fromiter(flat, np.int64, int(counts.sum())), counts


def index_vectors() -> np.ndarray:
    """The fixed sparse vector of each bucket, written out."""
    places, signs = index_places()
    out = np.zeros((BUCKETS, DIMS), np.int64)
    np.add.at(out, (np.arange(BUCKETS)[:, None], places), signs)
    return out


def index_places() -> tuple[np.ndarray, np.ndarray]:
    """Where each bucket's index vector is not nought, and the signs there (buckets x NONZERO)."""
    places, signs = [], []
    for k in range(NONZERO):
        h = mix(np.arange(BUCKETS, dtype=np.uint64) * ODD + np.uint64(k))
        places.append((h % np.uint64(DIMS)).astype(np.int64))
        signs.append(np.where(h >> np.uint64(63), 1, -1))
    return np.stack(places, axis=1), np.stack(signs, axis=1).astype(np.int64)


def _add_contexts(total: np.ndarray, places: np.ndarray, signs: np.ndarray, ids: np.ndarray,
                  counts: np.ndarray) -> None:
    """Adds to each token's row the index vectors of its neighbours in the same text.

    Pairs of neighbours are counted first, so that an index vector, which is sparse, is added once
    for each different pair.
    """
    text = np.repeat(np.arange(len(counts)), counts)
    pairs = []
    for step in range(1, REACH + 1):
        near = text[step:] == text[:-step]
        pairs.append((ids[:-step][near] * BUCKETS + ids[step:][near]).astype(np.uint32))
    pairs = np.sort(np.concatenate(pairs))
    if not len(pairs):
        return
    first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
    times = np.diff(np.r_[first, len(pairs)])
    a, b = np.divmod(pairs[first].astype(np.int64), BUCKETS)
    flat = total.reshape(-1)
    for word, other in ((a, b), (b, a)):
        np.add.at(flat, (word[:, None] * DIMS + places[other]).ravel(),
                  (times[:, None] * signs[other]).ravel())


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors (buckets x dims) from the contexts of all words of the corpus.

    Each task adds up its own table; the tables are summed by bucket in Spark, and one table comes
    to the driver, whose size is fixed.
    """
    def run(batches):
        total, bucketer = np.zeros((BUCKETS, DIMS), np.int64), Bucketer()
        places, signs = index_places()
        for _, values in blocks(batches):
            _add_contexts(total, places, signs, *bucketer.texts(values))
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32))] + [pa.array(total[used, d]) for d in range(DIMS)],
            ["bucket"] + [f"v{d}" for d in range(DIMS)])

    names = [f"v{d}" for d in range(DIMS)]
    got = (texts(docs).mapInArrow(run, "bucket int, " + ", ".join(f"{v} long" for v in names))
           .groupBy("bucket").agg(*[F.sum(v).alias(v) for v in names]).toArrow())
    out = np.zeros((BUCKETS, DIMS))
    if got.num_rows:
        out[got.column("bucket").to_numpy()] = np.stack(
            [got.column(v).to_numpy() for v in names], axis=1)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    return out.astype(np.float32)


def pool(vectors: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text: mean and spread of its vectors, log length, share of distinct buckets."""
    out = np.zeros((len(counts), 2 * DIMS + 2), np.float32)
    ends = np.cumsum(counts)
    for i, (e, n) in enumerate(zip(ends.tolist(), counts.tolist())):
        if n:
            used, times = np.unique(ids[e - n:e], return_counts=True)
            v, w = vectors[used], (times / n).astype(np.float32)
            mean = w @ v
            out[i, :DIMS] = mean
            out[i, DIMS:2 * DIMS] = np.sqrt(np.maximum(w @ (v * v) - mean * mean, 0))
            out[i, -2:] = np.log1p(n), len(used) / n
    return out


@dataclass
class QualityNetwork:
    """Standardisation, a hidden layer of rectified units, one output, a temperature."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.centre) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x.astype(float)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, share: float, hidden: int = 24, steps: int = 500,
        decay: float = 3e-3, seed: int = 11) -> QualityNetwork:
    """Adam on the whole sample, weighted to the classes' true ``share``; temperature on a fifth."""
    x, y = x.astype(float), y.astype(float)
    g = np.random.default_rng(seed)
    d = x.shape[1]
    if not 0 < y.sum() < len(y):
        share = min(max(share if len(y) else 0.0, 1e-9), 1 - 1e-9)
        return QualityNetwork(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1),
                              np.zeros(1), float(np.log(share / (1 - share))))
    aside = np.arange(len(y)) % 5 == 4
    if not 0 < y[aside].sum() < aside.sum() or not 0 < y[~aside].sum() < (~aside).sum():
        aside[:] = False
    tx, ty = x[~aside], y[~aside]
    share = min(max(share, 1e-3), 1 - 1e-3)

    def weights(labels):
        w = np.where(labels > 0, share / max(labels.sum(), 1),
                     (1 - share) / max((1 - labels).sum(), 1))
        return w / w.sum()
    weight = weights(ty)
    p = [g.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden),
         g.normal(0, (1 / hidden) ** 0.5, hidden), np.zeros(1)]
    net = QualityNetwork(tx.mean(axis=0), tx.std(axis=0) + 1e-6, *p[:3], 0.0)
    z = (tx - net.centre) / net.scale
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, steps + 1):
        pre = z @ p[0] + p[1]
        act = np.maximum(pre, 0)
        error = (1 / (1 + np.exp(-np.clip(act @ p[2] + p[3], -30, 30))) - ty) * weight
        back = np.outer(error, p[2]) * (pre > 0)
        grads = [z.T @ back + decay * p[0] / hidden, back.sum(axis=0),
                 act.T @ error + decay * p[2] / hidden, error.sum(keepdims=True)]
        for k, grad in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad ** 2
            p[k] -= 0.01 * (m[k] / (1 - 0.9 ** step)) / (
                np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = p[0], p[1], p[2], float(p[3][0])
    held = aside if aside.any() else ~aside
    logits, truth, w = net.logits(x[held]), y[held], weights(y[held])

    def loss(t):
        q = np.clip(1 / (1 + np.exp(-np.clip(logits / t, -30, 30))), 1e-9, 1 - 1e-9)
        return -(w * (truth * np.log(q) + (1 - truth) * np.log(1 - q))).sum()
    net.temperature = float(min(np.geomspace(0.5, 8, 33), key=loss))
    return net


def _pooled(rows: DataFrame, vectors, carry: str, kind: str) -> DataFrame:
    def run(batches):
        bucketer = Bucketer()
        for batch, values in blocks(batches):
            x = pool(vectors.value, *bucketer.texts(values))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float32()))],
                ["doc_id", carry, "x"])

    return rows.select("doc_id", "text", carry).mapInArrow(
        run, f"doc_id long, {carry} {kind}, x array<float>")


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, folds: int = 5,
          held_out: int = 0, per_class: int = 3000) -> QualityNetwork:
    """Fits on at most ``per_class`` labelled rows of each class outside the held-out fold."""
    spark = docs.sparkSession
    sample = labelled_sample(labels, "quality", folds, held_out, per_class)
    share = (labels.filter((fold(F.col("doc_id"), folds) != held_out)
                           & F.col("quality").isin(0, 1))
             .agg(F.avg("quality").alias("share")).first()["share"])
    rows = _pooled(texts(docs).join(F.broadcast(sample), "doc_id"),
                   spark.sparkContext.broadcast(vectors), "y", "int")
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "x").toArrow()
    x = np.array(got.column("x").to_pylist(), np.float32).reshape(-1, 2 * DIMS + 2)
    return fit(x, np.array(got.column("y").to_pylist(), float), float(share or 0.0))


def score_documents(docs: DataFrame, vectors: np.ndarray, net: QualityNetwork) -> DataFrame:
    """(doc_id, score) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def run(batches):
        bucketer = Bucketer()
        table, network = shared.value
        for batch, values in blocks(batches):
            x = pool(table, *bucketer.texts(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(network.scores(x))],
                                             ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")
