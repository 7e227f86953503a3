"""Best-fit decreasing packing of token sequences, exact over the whole corpus.

1. Texts become token ids; what is longer than a sequence is cut into pieces of its length.
2. Pieces are counted by length. There are at most ``capacity`` lengths, however large the corpus,
   so these counts are all that reaches the driver.
3. :func:`best_fit_decreasing` goes through the lengths from the longest. A segment tree over the
   remaining capacities finds the tightest open bin in logarithmic time. Pieces of one length and
   bins of one remaining capacity are alike, so whole runs of them are placed at a time; the bins
   are those that placing one piece after the other gives. The outcome is a list of rules: from
   which rank on pieces of a length go into which bins.
4. Every piece gets its rank among those of its length, in buckets of bounded size, and looks up its
   rule. Rules are bounded by the capacity and not by the corpus (a few thousand for 4096), so they
   are sent to all tasks.

Defined cases: a null text is empty and has the end token alone; a null id stays null; rows that
repeat are pieces of their own; an empty table gives an empty result; other columns are not read.
A very long text is tokenised in slices that end at white space, and its pieces leave the task as
they fill, so memory holds one slice.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from flowguard.llm.common import cut, texts

#: Tokens of a sequence, and the id that ends each document.
CAPACITY, END = 4096, 1
#: Characters that are tokenised at a time.
SLICE = 500_000
#: Pieces of one length that are ranked in one task.
BUCKET = 50_000


class Room:
    """Segment tree over remaining capacities 0 to ``capacity``: which of them open bins have."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = bytearray(2 * self.size)

    def set(self, r: int, value: bool) -> None:
        node = r + self.size
        self.open[node] = value
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] | self.open[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of ``least`` or more, if a bin has one."""
        node = least + self.size
        if self.open[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node + (not self.open[2 * node])
                return node - self.size
            node //= 2
        return None


@dataclass
class Rule:
    """Pieces of ``length`` from rank ``first`` on go ``each`` to a bin, from ``bin`` on."""
    length: int
    first: int
    bin: int
    each: int
    offset: int


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[list[Rule], int]:
    """Rules for all pieces, and the number of bins; ``counts`` has pieces by length."""
    room, bins = Room(capacity), {}  # remaining capacity: [(first bin, number)]
    rules, used = [], 0

    def put(r: int, first: int, number: int) -> None:
        if r and number:
            if r not in bins:
                bins[r] = []
                room.set(r, True)
            bins[r].append((first, number))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            r = room.tightest(length)
            if r is None:
                new = -(-left // (capacity // length))
                put(capacity, used, new)
                used += new
                continue
            first, number = bins[r].pop()
            if not bins[r]:
                del bins[r]
                room.set(r, False)
            # A bin that was the tightest is so until it can't take another piece.
            each = r // length
            full = min(number, left // each)
            rest = left - full * each if full < number else 0
            if full:
                rules.append(Rule(length, rank, first, each, capacity - r))
                put(r - each * length, first, full)
                rank += full * each
            if rest:
                rules.append(Rule(length, rank, first + full, rest, capacity - r))
                put(r - rest * length, first + full, 1)
                rank += rest
            put(r, first + full + (rest > 0), number - full - (rest > 0))
            left -= full * each + rest
    return rules, used


class Codes(dict):
    """Numbers words as they are asked for, and lists the new ones."""

    def __init__(self, words=()):
        super().__init__(zip(words, range(len(words))))
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        self.fresh.append(word)
        return code


class Words:
    """Token ids of words that white space parts; those seen are looked up.

    The split takes blanks and line breaks alone, which the tokenizer drops and never joins over. A word
    of plain letters with marks behind it is looked up as two pieces, the letters lower-cased, since the
    tokenizer does so too; all other words go through the tokenizer whole.
    """

    #: Marks that never join a letter before them, and texts of letters whose lower case and normal
    #: form are single letters.
    MARKS = ".,;:!?#$%&*"
    LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch

    def __init__(self, spec: str, remember: int = 500_000):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(1 + max(vocab.values(), default=0), bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.remember = remember
        self._forget()

    def _forget(self) -> None:
        self.hits = np.zeros(0, np.int64)
        self.seen = Codes()
        self.pieces: dict[str, int] = {"": 0}
        self.parts = np.zeros((0, 2), np.int64)
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(2, np.int64)

    def _forget_rare(self) -> None:
        """Keeps the words met more than once, at most half as many as are remembered."""
        often = np.flatnonzero(self.hits > 1)
        if len(often) > self.remember // 2:
            often = np.sort(often[np.argsort(-self.hits[often], kind="stable")[:self.remember // 2]])
        names, keys = list(self.seen), list(self.pieces)
        parts, hits, ids, ends = self.parts[often], self.hits[often], self.ids, self.ends
        used = np.setdiff1d(parts, [0])
        self._forget()
        self.seen = Codes([names[i] for i in often.tolist()])
        # Counted afresh, so words that are met no more go the next time.
        self.hits = np.minimum(hits, 1)
        sizes = ends[used + 1] - ends[used]
        at = np.repeat(ends[used] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        self._learn([keys[i] for i in used.tolist()], ids[at], sizes)
        self.parts = np.where(parts > 0, np.searchsorted(used, parts) + 1, 0)

    def _learn(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.pieces.update(zip(names, range(len(self.pieces), len(self.pieces) + len(names))))
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def _words(self, fresh: list[str]) -> None:
        heads, tails, letters, known = [], [], set(), self.pieces
        for w in fresh:
            head = w.rstrip(self.MARKS)
            if head.isalpha() and (head.isascii() or self.LATIN(head)):
                tails.append(w[len(head):])
                head = head.lower()
                if head not in known:
                    letters.add(head)
            else:
                head = w
                tails.append("")
            heads.append(head)
        # Words of letters are one piece each, whose last token and no other ends a word.
        if letters:
            letters = list(letters)
            ids = np.array(self.tokenizer.encode_batch_fast(
                [" ".join(letters)], add_special_tokens=False)[0].ids)
            ends = np.flatnonzero(self.last[ids]) + 1
            self._learn(letters, ids, np.diff(np.r_[0, ends]))
        rest = [p for p in {*heads, *tails} if p not in known]
        if rest:
            made = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
            sizes = np.fromiter(map(len, made), np.int64, len(made))
            self._learn(rest, np.fromiter(chain.from_iterable(made), np.int64, int(sizes.sum())), sizes)
        pairs = [np.fromiter(map(known.__getitem__, p), np.int64, len(fresh)) for p in (heads, tails)]
        self.parts = np.concatenate([self.parts, np.stack(pairs, axis=1)])

    def encode(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.seen) > self.remember:
            self._forget_rare()
        split = [p.replace("\n", " ").split(" ") for p in parts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        codes = np.fromiter(map(self.seen.__getitem__, chain.from_iterable(split)), np.int64,
                            int(sizes.sum()))
        if self.seen.fresh:
            self._words(self.seen.fresh)
            self.seen.fresh = []
        self.hits = np.r_[self.hits, np.zeros(len(self.parts) - len(self.hits), np.int64)]
        self.hits += np.bincount(codes, minlength=len(self.hits))
        piece = self.parts[codes].ravel()
        begin = self.ends[piece]
        counts = self.ends[piece + 1] - begin
        total = np.r_[0, np.cumsum(counts)]
        flat = self.ids[np.repeat(begin - total[:-1], counts) + np.arange(total[-1])]
        return np.split(flat, total[2 * np.cumsum(sizes)][:-1])


@lru_cache(maxsize=1)
def words_of(spec: str) -> Words:
    """A tokenizer's words, which a Python process keeps from task to task."""
    return Words(spec)


def slices(text: str, size: int = SLICE):
    """Parts of about ``size`` characters that end before a blank or a line break."""
    start = 0
    while len(text) - start > size:
        at = max(text.rfind(" ", start, start + size), text.rfind("\n", start, start + size))
        if at <= start:
            after = [i for i in (text.find(c, start + size) for c in " \n") if i >= 0]
            if not after:
                break
            at = min(after)
        yield text[start:at]
        start = at
    yield text[start:]


def _rounds(values: list[str], size: int):
    """Lists of (row, part, whether it is the row's last) of about ``size`` characters."""
    now, total = [], 0
    for i, text in enumerate(values):
        parts = slices(text, size) if len(text) > size else (text,)
        held = None
        for part in parts:
            if held is not None:
                now.append((i, held, False))
            held = part
            total += len(part)
            if total >= size and now:
                yield now
                now, total = [], len(part)
        now.append((i, held, True))
    if now:
        yield now


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END,
                 with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) and, if wanted, the ids of every piece."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    spec = docs.sparkSession.sparkContext.broadcast(spec)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = words_of(spec.value)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            values = [t or "" for t in batch.column(1).to_pylist()]
            held, start, piece = [], 0, 0
            for work in _rounds(values, SLICE):
                rows = []
                for (row, _, last), got in zip(work, words.encode([w[1] for w in work])):
                    held.append(got)
                    if last:
                        held.append(np.array([end], np.uint32))
                    elif sum(map(len, held)) <= capacity:
                        continue
                    flat = np.concatenate(held)
                    # Without its end a text keeps one token back: there is more to come.
                    stop = len(flat) if last else (len(flat) - 1) // capacity * capacity
                    for at in range(0, stop, capacity):
                        own = flat[at:at + capacity]
                        rows.append((ids[row], piece, start, len(own),
                                     zlib.crc32(own.astype("<u4").tobytes()))
                                    + ((own.tolist(),) if with_ids else ()))
                        piece, start = piece + 1, start + len(own)
                    held = [] if last else [flat[stop:]]
                    if last:
                        start = piece = 0
                if rows:
                    columns = list(zip(*rows))
                    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(),
                             pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, types)], names)

    return texts(docs).mapInArrow(run, PIECES + (", ids array<long>" if with_ids else ""))


def pack(pieces: DataFrame, capacity: int = CAPACITY,
         order=("doc_id", "piece", "start", "ids_crc32")) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` from 1 to ``capacity``.

    ``order`` ranks pieces of one length; rows that tie in it must be equal. The pieces are read
    several times, so store them first.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    rules, _ = best_fit_decreasing(counts, capacity)
    rules.sort(key=lambda r: (r.length, r.first))
    table = spark.sparkContext.broadcast({
        name: np.array([getattr(r, name) for r in rules], np.int64)
        for name in ("length", "first", "bin", "each", "offset")})

    lengths = spark.createDataFrame([(k, 1 + n // BUCKET) for k, n in sorted(counts.items())],
                                    "_l long, _buckets long")
    rows = (pieces.join(F.broadcast(lengths), F.col("length") == F.col("_l"))
            .withColumn("_bucket", F.pmod(F.xxhash64(*order), F.col("_buckets")))
            .drop("_l", "_buckets"))
    before = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (rows.groupBy("length", "_bucket").count()
               .select(F.col("length").alias("_l"), F.col("_bucket").alias("_b"),
                       F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")))
    inside = W.partitionBy("length", "_bucket").orderBy(*order)
    ranked = (rows.withColumn("_rank", F.row_number().over(inside).cast("long"))
              .join(offsets, (F.col("length") == F.col("_l")) & (F.col("_bucket") == F.col("_b")))
              .select(*pieces.columns, (F.col("_rank") + F.col("_before") - 1).alias("_rank")))
    names = [*pieces.columns, "sequence_id", "offset"]
    at = names.index("length")

    def run(batches):
        rule = table.value
        starts = (rule["length"] << 40) + rule["first"]
        for batch in batches:
            length = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            i = np.searchsorted(starts, (length << 40) + rank, "right") - 1
            own = rank - rule["first"][i]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(rule["bin"][i] + own // rule["each"][i]),
                 pa.array(rule["offset"][i] + own % rule["each"][i] * length)],
                names)

    schema = T.StructType(pieces.schema.fields)
    for name in ("sequence_id", "offset"):
        schema = schema.add(name, T.LongType())
    return ranked.mapInArrow(run, schema)


def packed_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Every piece of every document with its place: sequence_id and offset."""
    return pack(cut(token_pieces(docs, path, capacity, end)), capacity)


def packed_sequences(docs: DataFrame, path: str, capacity: int = CAPACITY,
                     end: int = END) -> DataFrame:
    """(sequence_id, ids, doc_ids): the sequences themselves; none is longer than ``capacity``."""
    placed = pack(cut(token_pieces(docs, path, capacity, end, with_ids=True)), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
