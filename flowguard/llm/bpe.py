"""Byte-pair encoding and decoding by a pair occurrence index.

A block holds every piece of text of a partition that has not been encoded before. An index
maps each mergeable pair, by its rank, to all positions where it stands in the block. Ranks are
taken in ascending order from a heap; all occurrences of a rank are merged at once, and only the
lists of the neighbouring pairs are extended. Entries that an earlier merge made stale are
recognised when their rank comes up. A pair that holds a merged symbol can only have been learnt
later than that symbol, so the order over the block gives every piece the merges it would get on
its own.

Defined cases: a null text is encoded as the empty text (no ids); a null id is kept as null; the
special token's string inside a text becomes the special token; repeated rows give repeated
results; an empty table gives an empty result. Other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from flowguard.llm.common import blocks, texts

#: Fixed value: the published split pattern of byte-level BPE.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A single blank between two other characters always starts a piece.
INNER_BLANK = r"(?<=\S)(?= \S)"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary file.

    Printable Latin-1 characters stand for themselves, the other bytes in turn for the
    characters from 256 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A vocabulary as arrays: hashed pair keys, the parts of each rank, token bytes."""

    def __init__(self, spec: dict):
        model, letters = spec["model"], byte_letters()
        vocab = model["vocab"]
        size = 1 + max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])])
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte_ids[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self._hash((self.left << 32) | self.right)

    SLOT_BITS = 20

    @classmethod
    def _slot(cls, keys: np.ndarray, odd: int) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(odd)) >> np.uint64(64 - cls.SLOT_BITS)).astype(
            np.int64)

    def _hash(self, keys: np.ndarray) -> None:
        """Two hash tables, the second for keys whose slot in the first is taken.

        Multipliers are tried in turn until no key is left over.
        """
        self.keys, odd = np.append(keys, -1), 0x9E3779B97F4A7C15
        while True:
            self.tables, left = [], np.arange(len(keys))
            for _ in range(2):
                odd = (odd * 6364136223846793005 + 1442695040888963407) % 2 ** 64 | 1
                slots = np.full(1 << self.SLOT_BITS, len(keys), np.int32)
                at = self._slot(keys[left], odd)
                slots[at] = left
                self.tables.append((odd, slots))
                left = left[slots[at] != left]
            if not len(left):
                return

    @classmethod
    def load(cls, path: str) -> "Merges":
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it has none."""
        want = (a << 32) | b
        odd, slots = self.tables[0]
        found = slots[self._slot(want, odd)]
        miss = np.flatnonzero(self.keys[found] != want)
        odd, slots = self.tables[1]
        found[miss] = slots[self._slot(want[miss], odd)]
        return np.where(self.keys[found] == want, found, -1)


def _sorted_once(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def _file_under_ranks(index: dict, heap: list, ranks: np.ndarray, at: np.ndarray) -> None:
    known = ranks >= 0
    ranks, at = ranks[known], at[known]
    if not len(ranks):
        return
    order = np.argsort(ranks, kind="stable")
    ranks, at = ranks[order], at[order]
    bounds = np.flatnonzero(np.diff(ranks)) + 1
    for rank, part in zip(ranks[np.r_[0, bounds]].tolist(), np.split(at, bounds)):
        if rank in index:
            index[rank].append(part)
        else:
            index[rank] = [part]
            heapq.heappush(heap, rank)


def encode_pieces(merges: Merges, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces in turn, and for each piece how many."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    sym = merges.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    n = len(sym)
    if not n:
        return sym, sizes
    ends = np.cumsum(sizes)
    begins = ends - sizes
    nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
    filled = sizes > 0
    nxt[ends[filled] - 1] = -1
    prv[begins[filled]] = -1
    index: dict = {}
    heap: list = []
    at = np.flatnonzero(nxt >= 0)
    _file_under_ranks(index, heap, merges.ranks(sym[at], sym[at + 1]), at)
    while heap:
        rank = heapq.heappop(heap)
        parts = index.pop(rank)
        at = _sorted_once(np.concatenate(parts)) if len(parts) > 1 else parts[0]
        a, b, made = merges.left[rank], merges.right[rank], merges.made[rank]
        at = at[(sym[at] == a) & (nxt[at] >= 0)]
        at = at[sym[nxt[at]] == b]
        if a == b and len(at) > 1:
            first = np.r_[True, nxt[at[:-1]] != at[1:]]
            i = np.arange(len(at))
            at = at[(i - np.maximum.accumulate(np.where(first, i, 0))) % 2 == 0]
        if not len(at):
            continue
        gone = nxt[at]
        after = nxt[gone]
        sym[at], sym[gone] = made, -1
        nxt[at] = after
        linked = after >= 0
        prv[after[linked]] = at[linked]
        before = prv[at]
        near = _sorted_once(np.concatenate([before[before >= 0], at[linked]]))
        if len(near):
            _file_under_ranks(index, heap, merges.ranks(sym[near], sym[nxt[near]]), near)
    alive = sym >= 0
    counts = np.zeros(len(pieces), np.int64)
    counts[filled] = np.add.reduceat(alive, begins[filled], dtype=np.int64)
    return sym[alive], counts


class PartitionEncoder:
    """Encodes the texts of one partition; pieces seen before are looked up.

    What is remembered is bounded by ``remember`` pieces, after which it starts anew.
    """

    def __init__(self, merges: Merges, remember: int = 250_000):
        self.merges, self.remember = merges, remember
        self.pieces = regex.compile(PIECES)
        self.inner = regex.compile(INNER_BLANK)
        self.special = regex.compile(
            "(" + "|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True))) + ")"
        ) if merges.special else None
        self._forget()

    def _forget(self):
        self.after_blank: dict[str, int] = {}
        self.alone: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.begin = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        for token, i in self.merges.special.items():
            self._add([token], np.array([i]), np.array([1]), self.alone)

    def _add(self, names, ids, counts, into):
        base, n = len(self.ids), len(self.count)
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.begin = np.concatenate([self.begin, base + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        into.update(zip(names, range(n, n + len(names))))

    def _learn(self, names: list[str], into: dict, lead: str) -> None:
        pieces, per_name = [], []
        for name in names:
            if name.isalpha():
                pieces.append((lead + name).encode())
                per_name.append(1)
            else:
                found = self.pieces.findall(lead + name)
                pieces.extend(p.encode() for p in found)
                per_name.append(len(found))
        ids, counts = encode_pieces(self.merges, pieces)
        ends = np.cumsum(per_name)
        totals = np.r_[0, np.cumsum(counts)]
        ends = totals[ends]
        self._add(names, ids, np.diff(np.r_[0, ends]), into)

    def _runs(self, text: str) -> list[str]:
        """Parts of any text, special tokens among them, that can be encoded on their own."""
        parts = []
        for run in self.special.split(text) if self.special else [text]:
            if run in self.merges.special:
                parts.append(run)
            elif run:
                parts.extend(self.inner.split(run))
        return parts

    def encode(self, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and for each text how many.

        Where single blanks stand between other characters, a text is its parts between blanks,
        each with its blank. Parts that show it is not so (empty, or with white space at an end)
        have the code -1; texts with such parts, and those with special tokens, go by
        :meth:`_runs`.
        """
        if len(self.count) > self.remember:
            self._forget()
        after, alone = self.after_blank, self.alone
        special = list(self.merges.special)
        split = [None if any(s in t for s in special) else t.split(" ") for t in values]
        fresh = set()
        for parts in split:
            if parts:
                fresh.update(parts)
        fresh = [p for p in fresh if p not in after]
        odd = [p for p in fresh if not p or p[0].isspace() or p[-1].isspace()]
        after.update(dict.fromkeys(odd, -1))
        if len(odd) < len(fresh):
            self._learn([p for p in fresh if p not in after], after, " ")
        codes = [parts and np.array([after[p] for p in parts], np.int64) for parts in split]
        slow = [i for i, c in enumerate(codes) if c is None or c.min() < 0]
        runs = {i: self._runs(values[i]) for i in slow}
        heads = {parts[0] for i, parts in enumerate(split) if i not in runs}
        fresh = (heads | {p for r in runs.values() for p in r}) - alone.keys()
        if fresh:
            self._learn(list(fresh), alone, "")
        for i, c in enumerate(codes):
            if i in runs:
                codes[i] = np.array([alone[p] for p in runs[i]], np.int64)
            else:
                c[0] = alone[split[i][0]]
        per_text = np.fromiter(map(len, codes), np.int64, len(codes))
        codes = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        counts = self.count[codes]
        total = np.r_[0, np.cumsum(counts)]
        flat = self.ids[np.repeat(self.begin[codes] - total[:-1], counts)
                        + np.arange(total[-1])]
        return flat, np.diff(np.r_[0, total[np.cumsum(per_text)]])


def decode_ids(merges: Merges, ids: list[int]) -> str:
    """The text of a list of ids; bytes that are no UTF-8 become replacement characters."""
    got = merges.token_bytes
    return b"".join([got[i] for i in ids]).decode("utf-8", "replace")


def _shared(spark: SparkSession, path: str):
    """The vocabulary on every executor: its size is that of the file, a few megabytes."""
    return spark.sparkContext.broadcast(Merges.load(path))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every text; the file is read on the driver only."""
    merges = _shared(docs.sparkSession, path)

    def run(batches):
        encoder = PartitionEncoder(merges.value)
        for batch, values in blocks(batches):
            flat, counts = encoder.encode(values)
            offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows made by :func:`encode_documents`; null ids give the empty text."""
    merges = _shared(encoded.sparkSession, path)

    def run(batches):
        for batch in batches:
            out = [decode_ids(merges.value, ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())],
                                             ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes, decodes from the ids, and digests both, in one pass over the texts.

    Returns doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256.
    """
    merges = _shared(docs.sparkSession, path)

    def run(batches):
        encoder = PartitionEncoder(merges.value)
        decimal = [str(i) for i in range(len(merges.value.token_bytes))]
        sha = hashlib.sha256
        for batch, values in blocks(batches):
            flat, counts = encoder.encode(values)
            ids_sha, text_sha, at = [], [], 0
            for n in counts.tolist():
                ids = flat[at:at + n].tolist()
                at += n
                ids_sha.append(sha(",".join([decimal[i] for i in ids]).encode()).hexdigest())
                text_sha.append(sha(decode_ids(merges.value, ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(ids_sha, pa.string()),
                 pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
