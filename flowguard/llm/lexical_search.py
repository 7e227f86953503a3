"""Ranked lexical search turned round: the items wait, the documents stream past them.

1. The terms of the items form an inverted index (term: items with their counts). It is cut into blocks
   by running totals of its size, so that what is sent to the tasks is bounded whatever the number of
   items; usually there is one block.
2. One pass over the documents turns each whole text into its length and the counts of those terms
   that the index knows. This is stored; the corpus statistics are sums over it.
3. The counts stream through the index: every term of a document adds its weight to the items that
   hold it. Each task keeps a heap of the k best documents per item, and the heaps are merged, first
   in parts and then per item.

Weights follow the integer form of BM25 that is written out in :func:`term_weights` and
:func:`_scores`; no score depends on how the rows are dealt out.

Defined cases: a null or empty text has no terms and is never found; an item without terms, or with
none that scores, has no rows; a null doc_id ranks after equal scores; documents that repeat are
ranked one by one, and items that repeat are answered one by one, with their own ranks; empty tables
give an empty result; other columns are not read. A very long text is taken apart in slices.
"""

from __future__ import annotations

import heapq
import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from flowguard.llm.common import cut, texts
from flowguard.operators.blocks import in_blocks, running

K = 20
#: Size of an index block: terms of its items, and ITEM_COST for each item.
POSTINGS, ITEM_COST = 300_000, 50
#: Bytes of a text, cells of scores, and additions that are worked on at a time.
SLICE, CELLS = 4_000_000, 2_000_000
#: ASCII letters and digits, letters lower-cased; all other ASCII becomes a blank. Bytes of longer
#: characters stay, so terms may hold any character beyond ASCII.
TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def term_slices(text: str):
    """Lists of the terms of a text, as UTF-8 bytes."""
    data = text.encode().translate(TERM_BYTES)
    start = 0
    while len(data) - start > SLICE:
        end = data.find(b" ", start + SLICE)
        if end < 0:
            break
        yield data[start:end].split(b" ")
        start = end
    yield data[start:].split(b" ")


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms, counts) of items that have terms; terms as bytes."""
    def run(batches):
        for batch in batches:
            ids, terms, counts = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own: dict = {}
                for part in term_slices(text or ""):
                    for term in part:
                        if term:
                            own[term] = own.get(term, 0) + 1
                if own:
                    ids.append(i)
                    terms.append(sorted(own))
                    counts.append([own[t] for t in terms[-1]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(terms, pa.list_(pa.binary())),
                 pa.array(counts, pa.list_(pa.int64()))], ["item_id", "terms", "counts"])

    return texts(items, "item_id").mapInArrow(
        run, "item_id long, terms array<binary>, counts array<long>")


class Index:
    """Inverted index of some items: items and counts of each term one after the other."""

    def __init__(self, rows):
        self.items = [r["item_id"] for r in rows]
        self.places: dict[bytes, int] = {}
        term, item, count = [], [], []
        for i, r in enumerate(rows):
            for t, n in zip(r["terms"], r["counts"]):
                term.append(self.places.setdefault(bytes(t), len(self.places)))
                item.append(i)
                count.append(n)
        term = np.array(term, np.int64)
        order = np.argsort(term, kind="stable")
        self.item = np.array(item, np.int64)[order]
        self.count = np.array(count, np.int64)[order]
        self.begin = np.r_[0, np.cumsum(np.bincount(term, minlength=len(self.places)))].astype(np.int64)


def index_blocks(items: DataFrame):
    """Indexes that together hold all items, each of bounded size."""
    rows = cut(item_terms(items))
    size = F.size("terms") + ITEM_COST
    total = rows.agg(F.sum(size)).first()[0] or 0
    if total <= POSTINGS:
        if total:
            yield Index(rows.collect())
        return
    keyed = rows.select(F.lit(0).alias("_all"), F.xxhash64("item_id", "terms").alias("_h"), "*")
    block = ((F.col("_sum") - 1) / POSTINGS).cast("long")
    placed = cut(running(in_blocks(keyed, ["_all"], ["_h"]), ["_all"], ["_h"],
                         {"_sum": ("sum", size.cast("long"))}).withColumn("_part", block))
    for part in range(math.ceil(total / POSTINGS)):
        own = placed.where(F.col("_part") == part).select("item_id", "terms", "counts").collect()
        if own:
            yield Index(own)


def known_terms(docs: DataFrame, index) -> DataFrame:
    """(doc_id, n, ids, tfs) of documents with terms; ``index`` is a broadcast :class:`Index`."""
    def run(batches):
        place = index.value.places.get
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, found = 0, []
                for terms in term_slices(text or ""):
                    ids = np.fromiter(map(place, terms, repeat(-1)), np.int64, len(terms))
                    n += len(terms) - terms.count(b"")
                    found.append(ids[ids >= 0])
                if n:
                    ids, tfs = np.unique(np.concatenate(found), return_counts=True)
                    rows.append((i, n, ids.astype(np.int32), tfs))
            ids, n, places, tfs = zip(*rows) if rows else ((),) * 4
            ends = np.r_[0, np.cumsum([len(p) for p in places])].astype(np.int32)
            flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (places, tfs)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[0].astype(np.int32))),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[1].astype(np.int64)))],
                ["doc_id", "n", "ids", "tfs"])

    return texts(docs).mapInArrow(run, "doc_id long, n long, ids array<int>, tfs array<long>")


def term_weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1)))
                     for d in df.tolist()], np.int64)


def _scores(index: Index, doc: np.ndarray, gains: np.ndarray, ids: np.ndarray,
            n_docs: int) -> np.ndarray:
    """Scores (documents x items): each term's gain goes to the items that hold it, times its count."""
    out = np.zeros(n_docs * len(index.items), np.int64)
    sizes = index.begin[ids + 1] - index.begin[ids]
    ends = np.cumsum(sizes)
    at = 0
    while at < len(ids):
        base = ends[at] - sizes[at]
        to = max(at + 1, int(np.searchsorted(ends, base + CELLS, "right")))
        n = sizes[at:to]
        place = np.repeat(index.begin[ids[at:to]] - (ends[at:to] - n - base), n) + np.arange(n.sum())
        np.add.at(out, np.repeat(doc[at:to] * len(index.items), n) + index.item[place],
                  np.repeat(gains[at:to], n) * index.count[place])
        at = to
    return out.reshape(n_docs, len(index.items))


class Heaps:
    """The k best (score, document) of every item."""

    def __init__(self, n_items: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(n_items)]
        self.least = np.ones(n_items, np.int64)

    def update(self, ids: list, scores: np.ndarray) -> None:
        least = self.least
        if len(ids) > self.k:
            least = np.maximum(least, np.partition(scores, -self.k, axis=0)[-self.k])
        docs, items = np.nonzero(scores >= least)
        for d, i, s in zip(docs.tolist(), items.tolist(), scores[docs, items].tolist()):
            heap = self.heaps[i]
            entry = (s, -(1 << 64) if ids[d] is None else -ids[d])
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.k:
                self.least[i] = heap[0][0]


def best_documents(known: DataFrame, index, k: int) -> DataFrame:
    """(item, item_id, doc_id, score): of each task, up to k documents for each item of the block."""
    totals = known.agg(F.count("*").alias("N"), F.sum("n").alias("L")).first()
    n_docs, n_terms = totals["N"], totals["L"] or 1
    df = np.zeros(len(index.value.places), np.int64)
    counted = known.select(F.explode("ids").alias("t")).groupBy("t").count().collect()
    for row in counted:
        df[row["t"]] = row["count"]
    weight = known.sparkSession.sparkContext.broadcast(term_weights(n_docs, df))

    def run(batches):
        own, w = index.value, weight.value
        heaps = Heaps(len(own.items), k)
        step = max(1, CELLS // len(own.items))
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            n = batch.column(1).to_numpy()
            lists = batch.column(2)
            doc = np.repeat(np.arange(len(n)), np.diff(lists.offsets.to_numpy()))
            ids = lists.flatten().to_numpy().astype(np.int64)
            tf = batch.column(3).flatten().to_numpy()
            m = (75 + (25 * n * n_docs) // n_terms)[doc]
            gains = w[ids] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
            heaps.update(batch.column(0).to_pylist(), _scores(own, doc, gains, ids, len(n)))
        out = [(i, own.items[i], None if e[1] == -(1 << 64) else -e[1], e[0])
               for i, heap in enumerate(heaps.heaps) for e in heap]
        columns = zip(*out) if out else ((),) * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], ["item", "item_id", "doc_id", "score"])

    return known.mapInArrow(run, "item long, item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item, those with a score above 0."""
    spark = docs.sparkSession
    out = None
    for index in index_blocks(items):
        shared = spark.sparkContext.broadcast(index)
        known = cut(known_terms(docs, shared))
        order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        parts = W.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(32))).orderBy(*order)
        found = (best_documents(known, shared, k)
                 .withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= k)
                 .withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order)))
                 .where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out
