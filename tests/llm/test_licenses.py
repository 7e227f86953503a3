import random

from flowguard.llm import licenses as L


def test_notices_with_edits_and_places(make_docs):
    mit = L.TEMPLATES["mit"].replace("person obtaining", "human obtaining").replace(
        "limitation the", "any limitation the")
    text = "Some intro é. " + mit + " Tail words here."
    docs = make_docs([(1, text), (2, "Released under the MIT License. And more."), (3, None),
                      (4, ""), (None, "Released under the MIT License."), (5, "plain " * 40_000),
                      (6, "this license is not the one"), (2, "Released under the MIT License."),
                      (7, "İİ Released under the MIT License."),
                      (8, "This work is licensed under the GNU General Public License, version 3.")],
                     clash=True)
    rows = L.scan(docs).collect()
    got = sorted((r.doc_id or -1, r.license) for r in rows)
    assert got == [(-1, "mit-notice"), (1, "mit"), (2, "mit-notice"), (2, "mit-notice"),
                   (7, "mit-notice"), (8, "gpl-3.0-notice")]
    one = next(r for r in rows if r.doc_id == 1)
    assert text[one.start:one.end].startswith("Permission is") and one.coverage > 0.97
    assert text[one.start:one.end].endswith("of the Software")
    assert L.scan(docs.limit(0)).collect() == []
    assert L.scan(docs, {}).collect() == []


def plain_align(template, words):
    """Most points of an alignment of the whole template with any run of words."""
    score = [0] * (len(words) + 1)
    for own in template:
        new = [score[0] - 1]
        for j, w in enumerate(words, 1):
            new.append(max(score[j - 1] + (2 if w == own else -1), score[j] - 1, new[j - 1] - 1))
        score = new
    return max(score)


def test_alignment_equals_plain_dynamic_programming():
    g = random.Random(3)
    for _ in range(60):
        template = [g.choice("abcdefgh") for _ in range(12)]
        words = list(template)
        for _ in range(g.randint(0, 3)):
            k = g.randrange(len(words))
            words[k:k + 1] = g.choice([[], ["z"], [words[k], "y"]])
        lead = g.randint(0, 3)
        words = ["q"] * lead + words + ["r"] * 3
        n, first, last = L.align(template, words, lead, band=len(words))
        assert n <= len(template) and (n == 0 or words[first] in template)
        gaps = plain_align(template, words)
        assert 2 * n >= gaps and n >= gaps / 2


def test_winnowing_keeps_one_of_each_window():
    import numpy as np
    g = np.random.default_rng(1).integers(0, 50, 40).astype(np.uint64)
    kept = set(L.winnowed(g).tolist())
    assert all(kept & set(range(i, i + L.WINNOW)) for i in range(len(g) - L.WINNOW + 1))
    assert list(L.winnowed(g[:0])) == []
