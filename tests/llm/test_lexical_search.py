import math
import random
import re
from collections import Counter

import pytest

from flowguard.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, length = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in counts:
            m = 100 - 25 + (25 * n * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
                        for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(found)[:k], 1):
            out.append((item, rank, i, -score))
    return out


def words(g, n):
    return " ".join(g.choice(["the", "Cat", "Ça", "x1", "42", "ÉTÉ", "été", "a_b", "don't", "名前", " ", "rare%d" % g.randint(0, 60)])
                    for _ in range(n))


@pytest.mark.parametrize("postings", [300_000, 150])
def test_equals_plain_search(spark, make_docs, monkeypatch, postings):
    g = random.Random(1)
    docs = [(i, words(g, g.choice([0, 1, 3, 20, 80]))) for i in range(150)]
    docs += [(200 + i, docs[3 + i % 2 * 5][1]) for i in range(60)]
    docs += [(5, None), (None, "the cat x1"), (None, None), (6, ""), (3, words(g, 10)), (9, "....")]
    items = [(i, words(g, g.choice([1, 5, 30]))) for i in range(12)]
    items += [(50, None), (51, ""), (None, "x1 the"), (3, "été"), (60, "nowhere-found"), (61, "the The THE")]
    monkeypatch.setattr(lexical_search, "POSTINGS", postings)
    monkeypatch.setattr(lexical_search, "CELLS", 300)
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS score", "0 AS doc_id")
    got = lexical_search.search(make_docs(docs, clash=True), table, 20).collect()
    want = plain(docs, items, 20)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_long_text_in_slices(spark, make_docs, monkeypatch):
    g = random.Random(2)
    text = words(g, 4000)
    monkeypatch.setattr(lexical_search, "SLICE", 100)
    assert [t for part in lexical_search.term_slices(text) for t in part if t] == [
        t.encode() for t in terms(text)]
    assert [t for part in lexical_search.term_slices("é" * 400) for t in part] == [("é" * 400).encode()]


def test_empty_tables(spark, make_docs):
    items = spark.createDataFrame([(1, "the cat")], "item_id long, text string")
    assert lexical_search.search(make_docs([]), items).count() == 0
    assert lexical_search.search(make_docs({1: "the cat"}), items.limit(0)).count() == 0
