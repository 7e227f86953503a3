import random
import re
from collections import Counter

from flowguard.llm import quality_rules as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(covered))


def test_measurements(make_docs):
    g = random.Random(1)
    texts = [None, "", " \n ", "a", "a b c d e", "x " * 3000, "a\nb\na\n\n a", "é#😀 $\x0bq"]
    texts += [" ".join(g.choice("abc") for _ in range(g.randint(0, 40))) for _ in range(60)]
    rows = R.measurements(make_docs(list(enumerate(texts)), clash=True)).collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
           for r in rows}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_policies_and_ablations(make_docs):
    good = " ".join(f"word{i}" for i in range(30))
    docs = make_docs([(1, good), (2, "short"), (3, good.replace(" ", "$$ ")), (4, "a b c d e " * 9),
                      (4, "a b c d e " * 9), (None, None)])
    rows = R.ledger(docs)
    kept = {r.doc_id: (r.kept, r.old) for r in R.apply_policy(
        R.apply_policy(rows, R.POLICIES["2"]), R.POLICIES["1"], "old").collect()}
    assert kept == {1: (True, True), 2: (False, False), 3: (False, True), 4: (False, False),
                    None: (False, False)}
    ablation = {r.rule: (r.n_failed, r.n_only_this)
                for r in R.ablations(rows, R.POLICIES["2"]).collect()}
    assert ablation["symbols"] == (1, 1) and ablation["too_short"] == (2, 2)
    assert ablation["repeated_windows"] == (2, 2)
    assert R.ledger(docs.limit(0)).collect() == []


def test_no_python_in_the_plan(make_docs):
    plan = R.ledger(make_docs({1: "a"}))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
