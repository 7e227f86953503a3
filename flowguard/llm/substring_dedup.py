"""Substring deduplication: winnowed anchors as seeds, extended both ways to whole windows.

A window is ``size`` consecutive words. Each window chooses the smallest hash among its word
``gram``-s (the last of equals) as its anchor, so equal windows choose equal anchors at equal
places, and consecutive windows mostly choose the same one. An anchor's occurrence is extended to
the span of all windows that chose it.

1. Anchors that occur once can't be part of a repeat and go.
2. Occurrences whose whole spans are equal form a class. Every member but the first is a repeat in
   all its windows.
3. Where an anchor has several classes, spans differ on one side or both; the first member of
   each class is then compared with the others window by window. Among equal windows all but
   the first are repeats.
4. The spans and windows found merge into maximal repeats, whose words are removed.

All sets of equals are reduced by aggregates that combine before the shuffle; no group is gathered
and no pairs are listed.

Defined cases: a null text has no words; texts shorter than a window keep all words; documents
with a null id are compared with nothing and keep all words. A place is an id, a text and a word number:
rows that repeat an id and its text are the same places and don't remove each other; different texts
under one id are documents of their own, in the order of a hash of the text. A text is hashed as one
block, some hundred bytes a word, so the longest text sets a worker's memory. An empty table gives an empty result. Other columns are
neither read nor returned.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowguard.llm.common import WORD, blocks, cut, texts
from flowguard.llm.words import ODD, WordHasher, grams, mix
from flowguard.operators.blocks import in_blocks, running

SIZE, GRAM = 20, 6
HALF = np.uint64(32)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    base = int(ODD)
    inverse = pow(base, -1, 2 ** 64)
    up, down = (np.full(n + 1, b, np.uint64) for b in (base, inverse))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Spans:
    """Hashes of any run of words of a block, from one pass of prefix sums."""

    def __init__(self, hashes: np.ndarray):
        self.up, self.down = _powers(len(hashes))
        self.lanes = [np.r_[np.uint64(0), np.cumsum(mix(hashes + np.uint64(k)) * self.down[:-1])]
                      for k in (0, 1)]

    def of(self, start: np.ndarray, end: np.ndarray, lane: int) -> np.ndarray:
        sums = self.lanes[lane]
        return mix((sums[end] - sums[start]) * self.up[start] + (end - start).astype(np.uint64))


def chosen_anchors(hashes: np.ndarray, counts: np.ndarray, size: int, gram: int):
    """Anchors of all windows of a block: place of the anchor, first and last window.

    Places count over the whole block; windows never reach from one text into the next.
    """
    n = len(hashes)
    if n < size:
        return (np.zeros(0, np.int64),) * 3
    # One number per place: half a hash to compare, then the place, later ones first.
    g = grams(hashes, gram) >> HALF << HALF
    g |= np.uint64(2 ** 32 - 1) - np.arange(len(g), dtype=np.uint64)
    m, width, want = n - size + 1, 1, size - gram + 1
    while width < want:
        step = min(width, want - width)
        g = np.minimum(g[:-step], g[step:])
        width += step
    at = (2 ** 32 - 1) - (g & np.uint64(2 ** 32 - 1)).astype(np.int64)
    ends = np.repeat(np.cumsum(counts), counts)
    starts = np.flatnonzero(np.arange(m) + size <= ends[:m])
    at = at[starts]
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    new = np.r_[True, at[1:] != at[:-1]]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(at)] - 1
    return at[first], starts[first], starts[last]


def anchors(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """(anchor, span, doc_id, first, n): hash of the anchor and of its whole span, first window
    and number of windows that chose it."""
    def run(batches):
        hasher = WordHasher()
        for batch, values in blocks(batches):
            hashes, counts = hasher.texts(values)
            at, first, last = chosen_anchors(hashes, counts, size, gram)
            spans = Spans(hashes)
            anchor = spans.of(at, at + gram, 0)
            span = mix(spans.of(first, last + size, 1) + (at - first).astype(np.uint64) * ODD)
            ends = np.cumsum(counts)
            owner = np.searchsorted(ends, first, side="right")
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(span.view(np.int64)),
                 batch.column(0).take(pa.array(owner)),
                 pa.array((first - (ends - counts)[owner]).astype(np.int32)),
                 pa.array((last - first + 1).astype(np.int32))],
                ["anchor", "span", "doc_id", "first", "n"])

    return (texts(docs).filter("doc_id IS NOT NULL")
            .mapInArrow(run, "anchor long, span long, doc_id long, first int, n int"))


def _windows(asked: DataFrame, size: int) -> DataFrame:
    """(w0, w1, doc_id, start) of every window asked for: rows of (doc_id, text, firsts, ns).

    Rows without ranges (null) ask for nothing.
    """
    def run(batches):
        hasher = WordHasher()
        for batch, values in blocks(b.filter(b.column(2).is_valid()) for b in batches):
            hashes, counts = hasher.texts(values)
            spans, begins = Spans(hashes), np.cumsum(counts) - counts
            owner, starts = [], []
            for i, (first, n) in enumerate(zip(batch.column(2).to_pylist(),
                                               batch.column(3).to_pylist())):
                n = np.array(n, np.int64)
                at = np.repeat(np.array(first, np.int64) - (np.cumsum(n) - n), n) + np.arange(
                    n.sum())
                at = at[at + size <= counts[i]]
                starts.append(at)
                owner.append(np.full(len(at), i))
            owner, starts = np.concatenate(owner), np.concatenate(starts)
            place = begins[owner] + starts
            yield pa.RecordBatch.from_arrays(
                [pa.array(spans.of(place, place + size, k).view(np.int64)) for k in (0, 1)]
                + [batch.column(0).take(pa.array(owner)), pa.array(starts.astype(np.int32))],
                ["w0", "w1", "doc_id", "start"])

    return asked.mapInArrow(run, "w0 long, w1 long, doc_id long, start int")


def repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """(doc_id, first, last): ranges of windows that also start earlier; ranges may overlap."""
    read = texts(docs)
    seeds = anchors(docs, size, gram)
    again = cut(seeds.groupBy("anchor").count().filter("count > 1").select("anchor"))
    seeds = cut(seeds.join(again, "anchor"))
    classes = seeds.groupBy("anchor", "span").agg(
        F.min(F.struct("doc_id", "first", "n")).alias("one"))
    # Whatever is not the first of its class: joined by place, so that no class is a hot key.
    later = (seeds.select("doc_id", "first", "n")
             .join(classes.select("one.doc_id", "one.first"), ["doc_id", "first"], "left_anti")
             .select("doc_id", "first", (F.col("first") + F.col("n") - 1).alias("last")))
    several = classes.groupBy("anchor").count().filter("count > 1").select("anchor")
    ranges = classes.join(several, "anchor").select("one.*").distinct()
    asked = (ranges.groupBy("doc_id").agg(F.collect_list(F.struct("first", "n")).alias("a"))
             .select("doc_id", F.col("a.first").alias("firsts"), F.col("a.n").alias("ns")))
    windows = _windows(read.join(asked, "doc_id", "left")
                       .select("doc_id", "text", "firsts", "ns"), size)
    firsts = windows.groupBy("w0", "w1").agg(F.min(F.struct("doc_id", "start")).alias("one"))
    places = ranges.select("doc_id", F.explode(F.sequence(
        F.col("first"), F.col("first") + F.col("n") - 1)).alias("start"))
    single = (places.join(firsts.select("one.*"), ["doc_id", "start"], "left_anti")
              .select("doc_id", F.col("start").alias("first"), F.col("start").alias("last")))
    return later.unionAll(single)


def merged(first: np.ndarray, last: np.ndarray, n_words: int, size: int) -> np.ndarray:
    """Which of a text's words the ranges of windows cover."""
    steps = np.zeros(n_words + 1, np.int64)
    np.add.at(steps, np.minimum(first, n_words), 1)
    np.add.at(steps, np.minimum(last + size, n_words), -1)
    return np.cumsum(steps[:-1]) > 0


def names_of_texts(read: DataFrame) -> DataFrame | None:
    """(doc_id, _h, key) with a number for every different text, in order of the ids.

    Null where no id has several texts, so that the ids themselves will do. Texts are read for
    this only if an id repeats.
    """
    named = read.where("doc_id IS NOT NULL")
    again = named.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return None
    h = F.xxhash64("text").alias("_h")
    if (named.join(again, "doc_id", "left_semi").select("doc_id", h).distinct().groupBy("doc_id")
            .count().where("count > 1").isEmpty()):
        return None
    every = named.select("doc_id", h).distinct().withColumn("_all", F.lit(0))
    order = ["doc_id", "_h"]
    return cut(running(in_blocks(every, ["_all"], order), ["_all"], order,
                       {"key": ("sum", F.lit(1).cast("long"))}).select("doc_id", "_h", "key"))


def remove_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept words joined by blanks, one row per row."""
    read = texts(docs)
    names = names_of_texts(read)
    if names is None:
        return _remove(read, size, gram)
    keyed = (read.withColumn("_h", F.xxhash64("text")).join(names, ["doc_id", "_h"], "left")
             .select(F.col("key").alias("doc_id"), "text"))
    done = _remove(keyed, size, gram).withColumnRenamed("doc_id", "key")
    return done.join(names.select("key", "doc_id"), "key", "left").select(
        "doc_id", "n_words", "n_removed", "kept")


def _remove(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """The same for rows whose ids tell their texts apart."""
    found = (repeats(docs, size, gram).groupBy("doc_id")
             .agg(F.collect_list(F.struct("first", "last")).alias("r"))
             .select("doc_id", F.col("r.first").alias("firsts"), F.col("r.last").alias("lasts")))

    def run(batches):
        for batch, values in blocks(batches):
            firsts, lasts = (batch.column(i).to_pylist() for i in (2, 3))
            n_words, n_removed, kept = [], [], []
            for text, first, last in zip(values, firsts, lasts):
                words = WORD.findall(text)
                n_words.append(len(words))
                if first:
                    gone = merged(np.array(first), np.array(last), len(words), size)
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                n_removed.append(n_words[-1] - len(words))
                kept.append(" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return (texts(docs).join(found, "doc_id", "left").select("doc_id", "text", "firsts", "lasts")
            .mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string"))
