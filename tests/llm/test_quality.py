import random
import zlib

import numpy as np

from flowguard.llm import quality_classifier as Q


def rows(n, seed=1):
    g = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{g.randint(0, 200)}" for _ in range(g.randint(5, 60))]
        bad = i % 5 == 0
        docs.append((i, " ".join(w + "$$$" if bad else w for w in words)))
        labels.append((i, 0 if bad else 1, 0))
    return docs, labels


def test_held_out_accuracy_and_edge_cases(make_docs, make_labels):
    docs, labels = rows(500)
    more = [(None, "w1 w2"), (900, None), (901, ""), (901, ""), (902, "w3 w4 " * 30_000)]
    table = make_docs(docs + more, clash=True)
    vectors = Q.word_vectors(table)
    net = Q.train(table, make_labels(labels + [(None, 1, 1), (3, None, None)]), vectors)
    got = Q.score_documents(table, vectors, net).collect()
    assert len(got) == len(docs) + len(more) and all(0 <= r.score <= 1 for r in got)
    score = {r.doc_id: r.score for r in got}
    held = [(score[i] >= 0.3) == bool(q) for i, q, _ in labels
            if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 50 and sum(held) / len(held) > 0.97
    assert Q.score_documents(table.limit(0), vectors, net).collect() == []
    assert not Q.word_vectors(table.limit(0)).any()


def test_vectors_do_not_depend_on_the_split(make_docs):
    table = make_docs(rows(60)[0])
    assert (Q.word_vectors(table.repartition(7)) == Q.word_vectors(table.coalesce(1))).all()


def test_contexts_equal_plain_sums():
    g = np.random.default_rng(1)
    counts = np.array([0, 5, 1, 9, 0])
    ids = g.integers(0, 50, counts.sum())
    index = Q.index_vectors()
    total = np.zeros((Q.BUCKETS, Q.DIMS), np.int64)
    Q._add_contexts(total, *Q.index_places(), ids, counts)
    want = np.zeros_like(total)
    at = 0
    for n in counts:
        own = ids[at:at + n]
        for i, w in enumerate(own):
            for k in range(max(0, i - Q.REACH), min(n, i + Q.REACH + 1)):
                if k != i:
                    want[w] += index[own[k]]
        at += n
    assert (total == want).all()


def test_without_both_classes():
    x = np.zeros((3, 2 * Q.DIMS + 2))
    assert (Q.fit(x, np.ones(3), 1.0).scores(x) > 0.99).all()
    assert (Q.fit(x[:0], np.ones(0), 0.0).scores(x) < 0.01).all()
