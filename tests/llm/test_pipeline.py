"""The whole pipeline against plain Python at its deterministic stages, on one small table."""

import random

import pytest

public = pytest.importorskip("public_tokenizers")

import corpus_pipeline as P  # noqa: E402
from flowguard.llm import bpe, near_dedup as N  # noqa: E402


@pytest.fixture
def folder(spark, tmp_path, make_docs, make_labels):
    g = random.Random(9)
    words = [f"word{i}" for i in range(400)]
    docs, labels = [], []
    item = " ".join(f"bench{i}" for i in range(24))
    for i in range(240):
        own = [g.choice(words) for _ in range(40)]
        if i % 4 == 0:
            own[g.randrange(40)] = "zorkin"
        if i % 10 == 1:
            own[10:10] = item.split()
        if i % 10 == 3:
            own.insert(7, "password=" + "".join(g.choice("0123456789abcdef") for _ in range(18)))
        docs.append((i, " ".join(own)))
        labels.append((i, 1, int(i % 4 == 0)))
    docs += [(1000 + i, docs[i][1]) for i in (2, 3, 5)] + [(2000, docs[6][1] + " tail"),
                                                         (3000, ""), (3001, None)]
    make_docs(docs).write.parquet(f"{tmp_path}/documents.parquet")
    make_labels(labels).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), dict(docs)


def test_stages_and_run(spark, folder):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == columns, name
    left = {i: t for i, t in texts.items() if "zorkin" not in (t or "")}
    sets = {i: N.shingle_set(t or "", 5) for i, t in left.items()}
    gone = {b for a in left for b in left if a < b and N.linked(
        len(sets[a] & sets[b]), len(sets[a]), len(sets[b]), 80)}
    left = {i: t for i, t in left.items() if i not in gone and "bench5" not in (t or "")}
    got = {r.doc_id: r for r in docs.collect()}
    assert set(got) == set(left)
    for i, r in got.items():
        assert "password" not in (r.text or "")
        if "password" not in (left[i] or ""):
            assert r.text == left[i]
        elif left[i]:
            assert "[REDACTED]" in r.text and r.n_chars == len(r.text)
    rows = P.run(spark, path)
    merges = bpe.Merges.load(public.path("byte_bpe_50k.json"))
    decoded = {r.doc_id: bpe.decode_ids(merges, r.ids) for r in rows.collect()}
    assert decoded == {i: r.text or "" for i, r in got.items()}


def test_registered():
    import __spark_entry__ as entry
    names = entry.queries()
    assert "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))
    assert {"op4_substring_dedup", "op9_near_duplicates", "op10_rule_ledger"} <= set(
        entry.oracle_sql())
