import random

from flowguard.llm import substring_dedup as S
from flowguard.llm.common import WORD


def brute(rows, size=20):
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for k in range(len(words) - size + 1):
            window = tuple(words[k:k + size])
            if window in seen:
                gone[k:k + size] = [True] * size
            seen.add(window)
        kept = [w for w, g in zip(words, gone) if not g]
        out[i] = (len(words), len(words) - len(kept), " ".join(kept))
    return out


def test_equals_brute_force(make_docs):
    g = random.Random(4)
    passages = [[f"p{k}_{i}" for i in range(60)] for k in range(4)]
    rows = []
    for i in range(80):
        words = [f"w{g.randint(0, 3000)}" for _ in range(g.randint(0, 60))]
        for _ in range(g.randint(0, 3)):
            p = g.choice(passages)
            a = g.randint(0, 45)
            at = g.randint(0, len(words))
            words[at:at] = p[a:a + g.randint(10, 60)]
        rows.append((i, " ".join(words)))
    rows += [(100, "a " * 90), (101, "a " * 25), (102, None), (103, ""), (104, rows[7][1]),
             (105, "a b " * 40), (106, "x y\x1cz " * 25)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept)
           for r in S.remove_repeats(make_docs(rows, clash=True)).collect()}
    assert got == brute(rows)


def test_null_ids_repeats_and_empty_tables(make_docs):
    text = " ".join(f"w{i}" for i in range(30))
    docs = make_docs([(None, text), (2, text), (2, text), (9, text)])
    got = sorted((r.doc_id or -1, r.n_removed) for r in S.remove_repeats(docs).collect())
    assert got == [(-1, 0), (2, 0), (2, 0), (9, 30)]
    assert S.remove_repeats(docs.limit(0)).collect() == []


def test_different_texts_under_one_id(make_docs):
    """A copy goes although its id also has another text; the other text and null ids stay."""
    t, o = (" ".join(f"{x}{i}" for i in range(40)) for x in "to")
    rows = [(1, t), (2, t), (2, o), (2, o), (3, o + " end"), (None, t), (4, None), (4, "short")]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in
                 S.remove_repeats(make_docs(rows, clash=True)).collect())
    assert got == sorted([(1, 40, 0), (2, 40, 40), (2, 40, 0), (2, 40, 0), (3, 41, 40), (0, 40, 0), (4, 0, 0),
                          (4, 1, 0)])
