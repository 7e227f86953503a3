import random

import pytest

from flowguard.llm import secrets as S
from flowguard.llm.q_secrets import joined


def corpus(n=160, seed=1):
    g = random.Random(seed)
    words = ["the", "river", "bluegreenyellowredwhite", "stone", "went"]
    out = []
    for i in range(n):
        text = [g.choice(words) for _ in range(30)]
        kind = i % 4
        hexed = "".join(g.choice("0123456789abcdef") for _ in range(32))
        key = "".join(g.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
        text[10] = [f"password={hexed[:18]}", f"AKIA{key}", f'token = "{hexed}"',
                    "".join(g.choice("0123456789") for _ in range(16))][kind]
        out.append((i, " ".join(text)))
    return out


@pytest.fixture(scope="module")
def net(spark):
    table = spark.createDataFrame(corpus(), "doc_id long, text string")
    return S.train(table, epochs=8)


def test_base_spans():
    text = "Token: 'abcdef' secret=ab12 api_key = x.y/z+9 " + "f" * 24 + " AKIA" + "Z" * 16
    assert S.base_spans(text) == [(0, 14, "assign"), (28, 45, "assign"), (46, 70, "hex"),
                                  (71, 91, "access")]
    assert S.base_spans("password=" + "a" * 30)[0] == (0, 39, "assign")
    assert S.base_spans("to\u017fen=abcdefg \u212aey") == []
    assert S.base_spans("") == []


def test_spans_of_all_kinds(spark, make_docs, net):
    docs = corpus(40, seed=2) + [(None, "x"), (500, None), (501, ""), (502, "word " * 50_000),
                                 (503, "key 4a9f0b7c2e1d8f6A5b4c3d2e1f0a9b8c end"),
                                 (503, "key 4a9f0b7c2e1d8f6A5b4c3d2e1f0a9b8c end")]
    got = S.scan(make_docs(docs, clash=True), net)
    rows = got.select("doc_id", "base", "spans", joined(got["base"]).alias("j")).collect()
    assert len(rows) == len(docs)
    text = dict(docs)
    for r in rows:
        base = S.base_spans(text[r.doc_id] or "")
        assert [tuple(x) for x in r.base] == base
        assert set(base) <= {tuple(x) for x in r.spans}
        assert r.j == ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        if r.doc_id is not None and r.doc_id % 4 == 3 and r.doc_id < 40:
            assert list(r.spans) == []
    assert S.scan(make_docs(docs).limit(0), net).collect() == []


def test_network_adds_what_the_patterns_miss(net):
    new = "8f3a-9C0b71d2E64f-a95b0c7D1e28"
    assert S.base_spans(new) == [] and S.candidates(new) == [(0, len(new))]
    p = net.scores([("key is ", new, " and"), ("card ", "4495114827612972", " paid"),
                    ("a ", "bluegreenyellowredwhite1", " b")])
    assert p[0] > p[1] and p[1] < net.threshold


def test_redaction(make_docs, net):
    docs = make_docs([(1, "a password=abcdef12345 b"), (2, None), (3, "clean"), (None, "clean")],
                     clash=True)
    got = S.redact(docs, net)
    rows = {r.doc_id: r for r in got.collect()}
    assert got.columns == docs.columns
    assert rows[1].text == "a [REDACTED] b" and rows[1].n_chars == 14
    assert rows[2].text is None and rows[3].text == "clean" and rows[None].text == "clean"
    assert S.redacted("abcdef", [(1, 3, "x"), (2, 4, "y")]) == "a[REDACTED]ef"


def test_nothing_to_learn_from():
    net = S.fit([], [])
    assert S.all_spans(["1234567890abcdefgh"], net)[0][1] == []


def test_copies_of_a_finding_count_once(make_docs):
    copies = [(i, f"a password=abcdef12345 b 1234567890abcdefg{h} c")
              for i, h in enumerate("h" * 60)]
    others = [(100 + i, f"a password=qwertz{i:05d} b 98765432{i:05d}zyx c") for i in range(8)]
    rows = S.labelled_findings(make_docs(copies + others), per_class=20).collect()
    for y, first in ((1, "abcdef12345"), (0, "1234567890abcdefgh")):
        own = [r.own for r in rows if r.y == y]
        assert len(own) == 9 and len(set(own)) == 9 and first in own


def test_short_candidates_behind_separators():
    text = "pwd=Xk29aq note: see 'q8Zt1pLm' it's fine a:b"
    found = [text[s:e] for s, e in S.candidates(text)]
    assert found == ["Xk29aq", "q8Zt1pLm"]
    assert [t for t in ("login: aB3dE6gH9jK2mN5pQ8", "x='abcdef'") if len(S.candidates(t)) != 1] == []


def test_long_windows_are_pooled_from_parts(net, monkeypatch):
    g = random.Random(9)
    windows = [("a", "".join(g.choice("abc123") for _ in range(n)), "z") for n in (6, 40, 700)]
    codes = [S.encode([w]) for w in windows]
    want = [net.forward(c)[0][0] for c in codes]
    monkeypatch.setattr(S, "PLACES", 64)
    assert [net.logits(c)[0] for c in codes] == pytest.approx(want)
    grads = S._gradients(net, windows, S.np.array([1, 0, 1]), S.np.ones(3))
    monkeypatch.setattr(S, "PLACES", 10 ** 9)
    whole = S._gradients(net, windows, S.np.array([1, 0, 1]), S.np.ones(3))
    assert all(grads[0][k] == pytest.approx(whole[0][k]) for k in grads[0])
    assert grads[1] == pytest.approx(whole[1])


def test_base_spans_equal_a_plain_search():
    """Every start and end tried, without the shortcuts of the scan."""
    import re
    g = random.Random(4)
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                        re.IGNORECASE | re.ASCII)
    for _ in range(300):
        text = "".join(g.choice(["password", "API_KEY", "token", "=", ":", " ", "'", "AKIA", "Q7", "ab12", "f" * 9,
                                 "0123456789ab", ".", "é", "\n"]) for _ in range(g.randint(0, 25)))
        want = []
        for k, (pattern, least) in enumerate(((assign, 6), (re.compile("AKIA[A-Z0-9]+"), 20),
                                              (re.compile("[0-9a-f]+"), 24))):
            at = 0
            while m := pattern.search(text, at):
                at = m.end()
                if len(m.group(2 if k == 0 else 0)) >= least:
                    want.append((m.start(), k, m.end()))
        assert S.base_spans(text) == [(s, e, S.KINDS[k]) for s, k, e in sorted(want)]


def test_every_finding_is_learnt_from(make_docs, monkeypatch):
    """More findings of a class than a part holds: all are taken, all parts train, none is left out."""
    texts = [(i, f"a password=abcdef{i:05d} b 1234567890abcdefg{i:05d}zz c") for i in range(1600)]
    rows = S.labelled_findings(make_docs(texts))
    assert {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()} == {0: 1600, 1: 1600}
    monkeypatch.setattr(S, "PART", 400)
    dealt, parts = S._dealt(rows, 3200)
    assert dealt.count() == 3200 and dealt.select("part").distinct().count() == parts == 8
    state = S.flat_state(S.SecretNetwork.start())
    got = S._round(dealt, state, {0: 1.0, 1: 1.0}, 3200, 1, 0, 7, 0)
    held = {}
    for r in dealt.collect():
        held.setdefault(r["part"], []).append(r)
    want = sum(S.train_part(state, [r[1:4] for r in p], S.np.array([float(r["y"]) for r in p]),
                            S.np.ones(len(p)), 1, 0, (7, 0, k)) * len(p) / 3200
               for k, p in held.items())
    assert got == pytest.approx(want, abs=1e-9)


def test_parts_learn_what_one_part_does(spark, monkeypatch):
    monkeypatch.setattr(S, "PART", 40)
    net = S.train(spark.createDataFrame(corpus(240, seed=5), "doc_id long, text string"), epochs=8)
    p = net.scores([("", "8f3a9c0b71d2e64fa95b0c7d1e28", ""), ("", "4495114827612972", "")])
    assert p[0] > p[1] and p[1] < net.threshold
