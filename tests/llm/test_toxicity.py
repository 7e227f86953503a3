import random

from flowguard.llm import toxicity as X

WORDS = [f"word{i}" for i in range(300)]


def labelled(n, seed=1, names=()):
    g = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [g.choice(WORDS) for _ in range(g.randint(5, 40))]
        bad = i % 4 == 0
        if bad:
            words[g.randrange(len(words))] = "zork" + g.choice(["a", "el", "in"])
            if names:
                words += [names[0]]
        elif names and g.random() < 0.05:
            words += [names[0]]
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_held_out_accuracy_and_edge_cases(make_docs, make_labels):
    docs, labels = labelled(600)
    more = [(None, "word1 zorkin word2"), (5000, None), (5001, ""), (5001, ""),
            (5002, "word3 " * 40_000)]
    table = make_docs(docs + more, clash=True)
    model = X.train(table, make_labels(labels + [(None, 1, 1), (1, None, None)]))
    got = X.score_documents(table, model).collect()
    assert len(got) == len(docs) + len(more) and all(0 <= r.score <= 1 for r in got)
    score = {r.doc_id: r.score for r in got}
    right = [(score[i] >= 0.7) == bool(t) for i, _, t in labels]
    assert sum(right) / len(right) > 0.98
    assert score[None] > 0.7 and max(score[5000], score[5001], score[5002]) < 0.3
    clean = X.keep_clean(table, model)
    assert clean.columns == table.columns
    ids = [r.doc_id for r in clean.collect()]
    assert None not in ids and ids.count(5001) == 2
    assert X.score_documents(table.limit(0), model).collect() == []


def test_counterfactuals_shrink_identity_weights():
    docs, labels = labelled(400, names=("muslim",))
    data = [(X.words_of(t), y) for (_, t), (_, _, y) in zip(docs, labels)]
    free = X.fit(data, 0.25, swap_penalty=0.0)
    fair = X.fit(data, 0.25, swap_penalty=30.0)
    cache = {}, {}
    neutral = X.words_of("a muslim word1 went to word2")
    assert fair.score(neutral, cache[0]) < free.score(neutral, cache[1])
    gap = [abs(m.word("muslim") - m.word("jewish")) for m in (free, fair)]
    assert gap[1] < gap[0] / 2


def test_swaps_and_single_class():
    assert X.swapped({"old", "tree"}, X.IDENTITY_TERMS) == {"young", "tree"}
    assert X.swapped({"tree"}, X.IDENTITY_TERMS) is None
    only = X.fit([({"a"}, 0), ({"b"}, 0)], 0.0)
    assert only.score({"a"}, {}) < 1e-6 and X.fit([], 0.0).score({"a"}, {}) < 1e-6


def test_labels_of_the_held_out_fold_change_nothing(make_docs, make_labels):
    import zlib
    docs, labels = labelled(200, seed=3)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    a, b = (X.train(make_docs(docs), make_labels(x)) for x in (labels, flipped))
    assert a == b


def test_train_equals_the_fit_in_plain_python(make_docs, make_labels):
    import zlib
    docs, labels = labelled(500, seed=5, names=("muslim",))
    kept = [(X.words_of(t), y) for (i, t), (_, _, y) in zip(docs, labels)
            if zlib.crc32(str(i).encode()) % 3 != 1]
    share = sum(y for _, y in kept) / len(kept)
    got = X.train(make_docs(docs), make_labels(labels))
    want = X.fit(kept, share, found_terms=400)
    assert got.pairs == want.pairs > 50
    assert got.weights.keys() == want.weights.keys()
    assert abs(got.intercept - want.intercept) < 1e-6
    assert all(abs(got.weights[f] - w) < 1e-6 for f, w in want.weights.items())
    assert abs(got.largest_change - want.largest_change) < 1e-6


def test_found_terms_change_the_model(make_docs, make_labels):
    """Words of both classes that share a beginning with toxic ones are held level."""
    docs, labels = labelled(500, seed=6)
    docs = [(i, t + (" zorka1" if i % 3 == 0 else " word1") + (" zorkx" if i % 5 else " other")) for i, t in docs]
    free, fair = (X.train(make_docs(docs), make_labels(labels), swap_penalty=p) for p in (0.0, 30.0))
    assert fair.pairs and fair.weights != free.weights
    assert fair.largest_change < free.largest_change
