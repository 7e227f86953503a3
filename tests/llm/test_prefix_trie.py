import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from flowguard.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows, heads=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if heads else 0
        base = c - int(c - 5 * int(c / 5))
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (
            (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p],
                   saved[p], hashlib.sha256(",".join(
                       str(c) for c in sorted(m) if len(built[c]) == len(p)).encode()).hexdigest())
                  for p, m in members.items())


def result(spark, rows, rebuild=pt.with_shared_heads, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.selectExpr("*", "'x' AS node", "'y' AS level", "1 AS i", "2 AS len", "0 AS a")
    return sorted(map(tuple, pt.prefix_trie(df, rebuild).collect()))


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_trie(spark, monkeypatch, seed):
    monkeypatch.setattr(pt, "CHUNK", 3)
    g = random.Random(seed)
    rows = []
    for c in [*range(-12, 30), *range(100, 400, 7)]:
        for turn in range(g.choice([1, 2, 3, 9, 20])):
            text = g.choice(["a", "b", "é", None, ""]) if g.random() < .3 else "same"
            rows.append((c, turn if turn else g.choice([0, None]), g.choice(["user", "user", None]), text))
    rows += [(None, 0, "user", "lost"), (None, None, None, None)]
    assert result(spark, rows, extra=True) == plain(rows)


def test_long_and_unchanged(spark):
    rows = [(c, t, "u", "x" if t < 70 or t % (c + 2) else "y") for c in range(6) for t in range(90 - 10 * c)]
    assert result(spark, rows, pt.as_they_are) == plain(rows, heads=False)


def test_copies_hold_most_conversations(spark, monkeypatch):
    monkeypatch.setattr(pt, "CHUNK", 50)
    rows = [(c, t, "u", "same %d" % t) for c in range(0, 3000, 5) for t in range(3)] + [(7, 0, "u", "other")]
    assert result(spark, rows) == plain(rows)


def test_turnless_and_empty(spark):
    rows = [(c, 0, "u", "t%d" % c) for c in (1, 2, 3, 4, 6, 7, 8, 9)]
    want = plain(rows)
    assert any(w[1] == 0 and w[7] != pt.EMPTY for w in want)
    assert result(spark, rows) == want
    assert result(spark, []) == []


def test_repeated_rows(spark):
    rows = [(5, 0, "u", "x"), (5, 0, "u", "x"), (5, 1, "a", "y"), (6, 0, "u", "x")] * 2
    assert result(spark, rows, pt.as_they_are) == plain(rows, heads=False)
