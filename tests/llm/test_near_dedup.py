import random

import pytest

from flowguard.llm import components as C, near_dedup as N

np = pytest.importorskip("numpy")


def brute(rows, n, percent):
    sets = {i: N.shingle_set(t or "", n) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and N.linked(len(sets[a] & sets[b]), len(sets[a]), len(sets[b]), percent):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def near_texts(seed, groups, size, words=60):
    g = random.Random(seed)
    rows, i = [], 0
    for k in range(groups):
        base = [f"w{g.randint(0, 500)}" for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(g.randint(0, 9)):
                own[g.randrange(words)] = f"x{g.randint(0, 10 ** 6)}"
            rows.append((i, " ".join(own)))
            i += 1
    g.shuffle(rows)
    return rows


def test_groups_equal_brute_force(make_docs, monkeypatch):
    rows = near_texts(3, 6, 25) + [(1000, ""), (1001, None), (1002, "one"), (1003, "ONE"),
                                   (1004, "two words"), (1005, " \n ")]
    want = brute(rows, 2, 80)
    monkeypatch.setattr(N, "TILE", 4)
    original = N.rest_of_buckets
    monkeypatch.setattr(N, "rest_of_buckets", lambda *a: original(*a, tile=4))
    got = N.near_duplicates(make_docs(rows, clash=True), n=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want
    assert len(got) == len(rows)
    assert len({c for _, c, _ in want.values()}) > 8


def test_null_ids_repeats_and_empty_tables(make_docs):
    text = " ".join(f"w{i}" for i in range(20))
    docs = make_docs([(None, text), (None, text), (5, text), (5, text), (3, text), (3, text)],
                     clash=True)
    got = sorted((r.doc_id or -1, r.component_id, r.kept)
                 for r in N.near_duplicates(docs).collect())
    assert got == [(-1, None, True), (-1, None, True), (3, 3, True), (3, 3, True), (5, 3, False),
                   (5, 3, False)]
    kept = N.keep_one_of_each(docs)
    assert kept.columns == docs.columns and {r._rank for r in kept.collect()} == {"x"}
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 3]
    assert N.near_duplicates(docs.limit(0)).collect() == []


def test_signatures_estimate_similarity():
    g = np.random.default_rng(5)
    x = g.integers(0, 2 ** 63, 1200, dtype=np.uint64)
    sets = [x[:1000], x[100:1100], x[:3], x[:3], x[:1]]
    sig = N.super_min_hash(sets, 200)
    assert abs((sig[0] == sig[1]).mean() - 900 / 1100) < 0.12
    assert (sig[2] == sig[3]).all()
    assert len(set((sig >> np.uint64(48))[4].tolist())) == 200


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(200, 260)]
    star = [(7, i) for i in range(300, 340)]
    links = spark.createDataFrame(chain + star + [(9, 9)], "a long, b long")
    got = {r.node: r.comp for r in C.components(links).collect()}
    assert got == {**{i: 200 for i in range(200, 261)}, 7: 7, **{i: 7 for i in range(300, 340)}}
    assert C.components(links.limit(0)).collect() == []
