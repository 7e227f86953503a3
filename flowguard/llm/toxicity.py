"""Toxicity: a linear classifier over words, regularised by counterfactuals.

A document's score is a sum over its distinct words; a word's part is the sum of the weights of
its features, the word itself and its beginnings. Identity terms in labelled texts are swapped
for other terms of their kind, and training penalises the squared change of the score, so that
naming a group does not make a neutral text toxic.

The classifier is fitted on a bounded sample of labelled rows (``per_class`` of each class, by
the hash of their id). Everything else covers all rows. Terms come as groups from the caller and are
also found among the sample's own words (:func:`train`). The executors extract and count features;
the driver fits on their numbers.

Defined cases: a null or empty text has no words and gets the score of the intercept; a null id
is kept as null; repeated rows give repeated results; without labels of both classes every score
is the share of toxic labels (0 if there are none); an empty table gives an empty result. Other
columns are neither read nor returned, except that :func:`keep_clean` passes all of them on.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowguard.llm.common import blocks, cut, fold, labelled_sample, texts

TOKEN = re.compile(r"\w+")
#: Lengths of the beginnings of a word that count as features.
BEGINNINGS = (3, 4, 5, 6, 7)
#: Terms that may be swapped for one another; a parameter, and these are its default.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("old", "young", "elderly"), ("deaf", "blind", "disabled"),
    ("immigrant", "native", "refugee"), ("immigrants", "natives", "refugees"),
)


def features(word: str) -> list[str]:
    """The word and its beginnings; a lower-case word never holds the mark of a beginning."""
    return [word, *("^" + word[:k] for k in BEGINNINGS if k < len(word))]


def words_of(text: str) -> set[str]:
    return set(TOKEN.findall(text.lower()))


def swapped(words: set[str], groups: Sequence[Sequence[str]]) -> set[str] | None:
    """The words with each identity term replaced by the next of its group; None without any."""
    following = {t: g[(i + 1) % len(g)] for g in groups for i, t in enumerate(g)}
    if following.keys().isdisjoint(words):
        return None
    return {following.get(w, w) for w in words}


@dataclass
class ToxicityModel:
    """``pairs`` swapped texts took part in the fit; the logit of none changes by more than
    ``largest_change`` when its terms are swapped."""
    intercept: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)
    pairs: int = 0
    largest_change: float = 0.0

    def word(self, word: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(word))

    def score(self, words: set[str], cache: dict[str, float]) -> float:
        total = self.intercept
        for w in words:
            part = cache.get(w)
            if part is None:
                part = cache[w] = self.word(w)
            total += part
        return 1.0 / (1.0 + np.exp(-min(max(total, -30.0), 30.0)))


def separation(n0, n1, size0, size1, sqrt=np.sqrt):
    """How far a feature's share of toxic texts is above that of others, in standard deviations.

    For numbers, arrays or columns.
    """
    p0, p1 = (n0 + 0.5) / (size0 + 1), (n1 + 0.5) / (size1 + 1)
    return (p1 - p0) / sqrt(p0 * (1 - p0) / size0 + p1 * (1 - p1) / size1)


def paired(words: Sequence[tuple[str, bool]], limit: int) -> list[tuple[str, str]]:
    """Groups of two out of (word, whether it has a beginning that counts), in the given order.

    A word with such a beginning goes with one without: swapping them changes the features of a
    text. At most ``limit`` groups.
    """
    marked = [w for w, m in words if m]
    return list(zip(marked, [w for w, m in words if not m]))[:limit]


def _ids(words: set[str], known: dict[str, int]) -> np.ndarray:
    return np.array(sorted(known[f] for w in words for f in features(w) if f in known), np.int64)


def _matrix(docs: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    rows = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    return rows, np.concatenate(docs) if len(docs) else np.zeros(0, np.int64)


def only_share(share: float) -> ToxicityModel:
    """The model without labels of both classes."""
    share = min(max(share, 1e-9), 1 - 1e-9)
    return ToxicityModel(float(np.log(share / (1 - share))))


def fit_weights(y: np.ndarray, docs: Sequence[np.ndarray],
                pairs: Sequence[tuple[np.ndarray, np.ndarray]], names: Sequence[str],
                positive_share: float, ridge: float = 1e-3, swap_penalty: float = 0.01,
                steps: int = 300) -> ToxicityModel:
    """Weights by Adam, from the features (by number) of each text and each swapped pair.

    The loss is the logistic loss, both classes with the same weight, plus a ridge and the mean
    squared difference of the logits of a text and its counterfactual. The intercept is then
    moved from even classes to ``positive_share``.
    """
    n = np.array([len(y) - y.sum(), y.sum()])
    rows, cols = _matrix(docs)
    drow, dcol = _matrix([np.concatenate(p) for p in pairs])
    sign = np.concatenate([np.r_[np.ones(len(a)), -np.ones(len(b))] for a, b in pairs]) \
        if len(pairs) else np.zeros(0)
    weight = np.where(y > 0, 0.5 / n[1], 0.5 / n[0])
    w, b = np.zeros(len(names)), 0.0
    mean, square = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, steps + 1):
        logit = b + np.bincount(rows, w[cols], minlength=len(y))
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * weight
        grad = np.bincount(cols, error[rows], minlength=len(w)) + ridge * w
        if len(pairs):
            change = np.bincount(drow, sign * w[dcol], minlength=len(pairs))
            grad += np.bincount(dcol, sign * change[drow], minlength=len(w)) * (
                2 * swap_penalty / len(pairs))
        full = np.r_[grad, error.sum()]
        mean = 0.9 * mean + 0.1 * full
        square = 0.999 * square + 0.001 * full ** 2
        move = 0.1 * (mean / (1 - 0.9 ** step)) / (
            np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    share = min(max(positive_share, 1e-4), 1 - 1e-4)
    b += np.log(share / (1 - share))
    change = np.bincount(drow, sign * w[dcol], minlength=len(pairs)) if len(pairs) else np.zeros(1)
    return ToxicityModel(float(b), {f: float(v) for f, v in zip(names, w) if v}, len(pairs),
                         float(np.abs(change).max()))


def fit(labelled: list[tuple[set[str], int]], positive_share: float,
        groups: Sequence[Sequence[str]] = IDENTITY_TERMS, min_docs: int = 4, min_z: float = 3.0,
        found_terms: int = 0, neutral_z: float = 1.5, **fitting) -> ToxicityModel:
    """The fit of :func:`train` for a few texts that are at hand as sets of words."""
    y = np.array([label for _, label in labelled], float)
    if not 0 < y.sum() < len(y):
        return only_share(positive_share if len(y) else 0.0)
    counts: dict[str, list[int]] = {}
    for words, label in labelled:
        for f in {f for w in words for f in features(w)}:
            counts.setdefault(f, [0, 0])[label] += 1
    size = float(len(y) - y.sum()), float(y.sum())
    z = {f: separation(*c, *size) for f, c in counts.items() if sum(c) >= min_docs}
    given = {t for g in groups for t in g}
    names = sorted(f for f, v in z.items() if v >= min_z or (f in given and v))
    known = {f: i for i, f in enumerate(names)}
    neutral = sorted((f for f, v in z.items() if not f.startswith("^") and f not in given
                      and counts[f][0] >= min_docs and v <= neutral_z),
                     key=lambda f: (-sum(counts[f]), f))
    groups = [*groups, *paired([(f, not known.keys().isdisjoint(features(f))) for f in neutral],
                               found_terms)]
    pairs = [(words, other) for words, _ in labelled
             if (other := swapped(words, groups)) is not None]
    return fit_weights(y, [_ids(words, known) for words, _ in labelled],
                       [(_ids(a, known), _ids(b, known)) for a, b in pairs], names,
                       positive_share, **fitting)


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1,
          per_class: int = 3000, groups: Sequence[Sequence[str]] = IDENTITY_TERMS,
          min_docs: int = 4, min_z: float = 3.0, found_terms: int = 400, neutral_z: float = 1.5,
          **fitting) -> ToxicityModel:
    """Fits on at most ``per_class`` labelled rows of each class outside the held-out fold.

    Terms to be swapped are the given ``groups`` and, in whatever languages the texts are, up to
    ``found_terms`` pairs of words that toxic texts do not hold more often than others. One of a pair
    begins like toxic words do, the other does not: neither says anything of toxicity, so exchanging them
    must not change the score. Spark counts the features; only the names of those that are used and the numbers of
    each text's come to the driver.
    """
    sample = labelled_sample(labels, "toxic", folds, held_out, per_class)
    shares = (labels.filter((fold(F.col("doc_id"), folds) != held_out)
                            & F.col("toxic").isin(0, 1))
              .agg(F.avg("toxic").alias("share")).first())

    def split(batches):
        for batch, values in blocks(batches):
            found = [sorted(words_of(t)) for t in values]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.string()))],
                ["doc_id", "y", "words"])

    rows = cut(texts(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "y")
               .mapInArrow(split, "doc_id long, y int, words array<string>"))
    size = rows.agg(*[F.count_if(F.col("y") == k).cast("double") for k in (0, 1)]).first()
    share = float(shares["share"] or 0.0)
    if not size[0] or not size[1]:
        return only_share(share if size[0] or size[1] else 0.0)

    def count(batches):
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for label, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for f in {f for w in words for f in features(w)}:
                    seen.setdefault(f, [0, 0])[label] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string())]
                + [pa.array([c[k] for c in seen.values()], pa.int64()) for k in (0, 1)],
                ["f", "n0", "n1"])

    counts = (rows.select("y", "words").mapInArrow(count, "f string, n0 long, n1 long")
              .groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
              .where(F.col("n0") + F.col("n1") >= min_docs)
              .withColumn("z", separation(F.col("n0"), F.col("n1"), *size, sqrt=F.sqrt)))
    counts = cut(counts)
    given = sorted({t for g in groups for t in g})
    names = sorted(r[0] for r in counts.where(
        (F.col("z") >= min_z) | (F.col("f").isin(given) & (F.col("z") != 0))).select("f").collect())
    begins = F.array(*[F.concat(F.lit("^"), F.substring("f", 1, k)) for k in BEGINNINGS])
    marked = F.arrays_overlap(begins, F.array(*map(F.lit, names)).cast("array<string>"))
    neutral = (counts.where(~F.col("f").startswith("^") & ~F.col("f").isin(given)
                            & (F.col("n0") >= min_docs) & (F.col("z") <= neutral_z))
               .select("f", (F.col("n0") + F.col("n1")).alias("n"), marked.alias("marked")))
    order = (F.col("n").desc(), "f")
    found = [(r["f"], r["marked"]) for side in (True, False) for r in
             neutral.where(F.col("marked") == side).orderBy(*order).limit(found_terms).collect()]
    all_groups = [*groups, *paired(found, found_terms)]
    known = {f: i for i, f in enumerate(names)}

    def encode(batches):
        for batch in batches:
            own, other = [], []
            for words in batch.column(2).to_pylist():
                words = set(words)
                swap = swapped(words, all_groups)
                own.append(_ids(words, known))
                other.append(None if swap is None else _ids(swap, known))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(own, kind), pa.array(other, kind)],
                ["doc_id", "y", "own", "other"])

    got = (rows.mapInArrow(encode, "doc_id long, y int, own array<int>, other array<int>")
           .orderBy("doc_id", "own", "other").select("y", "own", "other").toArrow())
    own = [np.array(v, np.int64) for v in got.column("own").to_pylist()]
    pairs = [(a, np.array(b, np.int64)) for a, b in zip(own, got.column("other").to_pylist())
             if b is not None]
    return fit_weights(got.column("y").to_numpy().astype(float), own, pairs, names, share, **fitting)


def _scorer(spark, model: ToxicityModel, remember: int = 150_000):
    """A function from texts to scores; the model has one number per selected feature."""
    shared = spark.sparkContext.broadcast(model)

    def start():
        cache: dict[str, float] = {}

        def scores(values: list[str]) -> np.ndarray:
            if len(cache) > remember:
                cache.clear()
            return np.array([shared.value.score(words_of(t), cache) for t in values], float)
        return scores
    return start


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of every text."""
    start = _scorer(docs.sparkSession, model)

    def run(batches):
        scores = start()
        for batch, values in blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(values))],
                                             ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: ToxicityModel, reject_from: float = 0.7) -> DataFrame:
    """The documents scored below ``reject_from``, with all their columns."""
    start = _scorer(docs.sparkSession, model)
    at = docs.columns.index("text")

    def run(batches):
        scores = start()
        for batch, values in blocks(batches, at):
            yield batch.filter(pa.array(scores(values) < reject_from))

    return docs.mapInArrow(run, docs.schema)
