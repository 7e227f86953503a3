import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from flowguard.llm import packing  # noqa: E402

PATH = public.path("word_bpe_49k.json")
ODD = ["", " ", "A  b\nC\t\td", "x<|endoftext|>y <|startoftext|> z", "it's WE'LL İstanbul ΟΔΟΣ ς Σ",
       "é ́e ä\n̈", "\x1c a\x85b c d　e", "１２３ ⅷ 42", "😀 a😀b", "\r\n \x0b\x0c",
       "ﬁ ﷺ Å", "q" * 5000, " ".join(["word"] * 9000)]


def plain_bins(lengths, capacity):
    """One piece after the other, longest first, into the tightest bin."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            best = min(fit, key=lambda i: rooms[i])
            rooms[best] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_rules_give_the_bins_of_plain_best_fit(seed):
    g = random.Random(seed)
    capacity = g.choice([1, 7, 64, 200])
    lengths = [min(capacity, 1 + int(g.expovariate(4 / capacity))) for _ in range(g.randint(0, 600))]
    counts = defaultdict(int)
    for n in lengths:
        counts[n] += 1
    rules, used = packing.best_fit_decreasing(counts, capacity)
    taken, placed = defaultdict(list), 0
    for k, n in counts.items():
        own = sorted((r for r in rules if r.length == k), key=lambda r: r.first)
        for i in range(n):
            rule = [r for r in own if r.first <= i][-1]
            at = i - rule.first
            taken[rule.bin + at // rule.each].append((rule.offset + at % rule.each * k, k))
            placed += 1
    assert placed == len(lengths) and len(taken) == used
    rooms = []
    for parts in taken.values():
        at = 0
        for offset, k in sorted(parts):
            assert offset == at
            at += k
        assert at <= capacity
        rooms.append(capacity - at)
    assert sorted(rooms) == plain_bins(lengths, capacity)


def test_words_equal_the_library():
    theirs = tokenizers.Tokenizer.from_file(PATH)
    g = random.Random(3)
    values = ODD + ["".join(g.choice(" \n\tabAB'stΣς́é1<|>endoftext ") for _ in range(g.randint(0, 60)))
                    for _ in range(3000)]
    with open(PATH, encoding="utf-8") as f:
        words = packing.Words(f.read(), remember=500)
    want = [e.ids for e in theirs.encode_batch(values, add_special_tokens=False)]
    got = [a.tolist() for i in range(0, len(values), 100) for a in words.encode(values[i:i + 100])]
    assert got == want


def test_slices():
    for size in (3, 10):
        for text in ("", "abc", "a b\nc d e f g", "abcdefghijklmnopqrst u v", " " * 20, "x" * 30):
            assert "".join(packing.slices(text, size)) == text


def test_pieces_and_places(spark, make_docs, monkeypatch):
    theirs = tokenizers.Tokenizer.from_file(PATH)
    monkeypatch.setattr(packing, "BUCKET", 20)
    g = random.Random(4)
    rows = [(i, t) for i, t in enumerate(ODD)]
    rows += [(100 + i, " ".join(g.choice(["the", "cat", "Sat", "on."]) for _ in range(g.randint(0, 300))))
             for i in range(200)]
    rows += [(7, None), (None, "no id here"), (None, None), (8, "repeated row"), (8, "repeated row")]
    capacity = 128
    pieces = packing.token_pieces(make_docs(rows, clash=True), PATH, capacity)
    got = packing.pack(pieces, capacity).collect()
    want = []
    for i, text in rows:
        ids = theirs.encode(text or "", add_special_tokens=False).ids + [1]
        for p, at in enumerate(range(0, len(ids), capacity)):
            own = np.array(ids[at:at + capacity], "<u4")
            want.append((i, p, at, len(own), zlib.crc32(own.tobytes())))
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(bins) == len(plain_bins([w[3] for w in want], capacity))


def test_a_long_text_leaves_in_pieces(spark, make_docs, monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 1000)
    theirs = tokenizers.Tokenizer.from_file(PATH)
    values = {1: "lorem ipsum dolor " * 3000, 2: "a b", 3: "amet " * 127, 4: "x" * 3000, 5: "amet " * 128}
    got = packing.packed_sequences(make_docs(values), PATH, 128).collect()
    assert all(len(r["ids"]) <= 128 for r in got)
    total = sum(len(theirs.encode(t, add_special_tokens=False).ids) + 1 for t in values.values())
    assert sum(len(r["ids"]) for r in got) == total
    pieces = packing.token_pieces(make_docs(values), PATH, 128, with_ids=True).collect()
    for i, t in values.items():
        own = sorted((r for r in pieces if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [x for r in own for x in r["ids"]] == theirs.encode(t, add_special_tokens=False).ids + [1]
        assert all(r["length"] == 128 for r in own[:-1]) and [r["start"] for r in own] == [
            128 * k for k in range(len(own))]


def test_empty_table(spark, make_docs):
    assert packing.packed_pieces(make_docs([]), PATH).count() == 0


def test_words_met_often_stay_known():
    """Past its bound the table keeps what recurs, and ids stay those of the library."""
    theirs = tokenizers.Tokenizer.from_file(PATH)
    with open(PATH, encoding="utf-8") as f:
        words = packing.Words(f.read(), remember=40)
    common = ["the", "Cat,", "sat", "7", "été.", ""]
    for i in range(30):
        texts = [" ".join(common + [f"w{i}x{j}", "ab" * j + "."]) for j in range(3)]
        learnt = words._words
        fresh = []
        words._words = lambda f: (fresh.extend(f), learnt(f))
        got = [a.tolist() for a in words.encode(texts)]
        words._words = learnt
        assert got == [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]
        assert i == 0 or not set(common) & set(fresh)
        assert len(words.seen) == len(words.parts) <= 40 + 10


def test_a_process_keeps_its_words():
    with open(PATH, encoding="utf-8") as f:
        spec = f.read()
    assert packing.words_of(spec) is packing.words_of("" + spec[:5] + spec[5:])
