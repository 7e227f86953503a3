import itertools
import random

import pytest

from flowguard.llm import decontamination as D

ITEM = ("A farmer sells 12 baskets of apples for 3 dollars each and Tom buys 5 of them. How much "
        "does Tom pay if he returns 2 baskets?")
PLAIN = "Thus the lazy river bends around seven hills before it meets an old stone bridge at dusk."


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(1, ITEM), (2, PLAIN), (3, None), (4, "1 2 3 4 5 6 7 8"),
                                  (5, "too short"), (None, PLAIN)], "item_id long, text string")


def pad(text, n=17):
    return " ".join(f"left{i}" for i in range(n)) + " " + text + " " + " ".join(
        f"right{i}" for i in range(n))


def test_copies_and_renamed_copies_are_found(make_docs, items):
    renamed = ITEM.replace("12", "340").replace("Tom", "Anna").replace("5", "7")
    broken = ITEM.replace("and Tom", "and Anna")  # one name became two
    docs = make_docs([(i, pad(PLAIN, i)) for i in range(8)]
                     + [(20, pad(ITEM)), (21, pad(renamed)), (22, pad(broken)),
                        (23, pad("1 2 3 4 5 6 7 8")), (24, None), (25, ""), (None, pad(PLAIN)),
                        (26, "w " * 50_000 + PLAIN), (27, pad("nothing to see")),
                        (28, pad(PLAIN)), (28, pad(PLAIN))], clash=True)
    for limit in (D.BROADCAST_WINDOWS, 0):
        rows = D.contaminated(docs, items, broadcast_windows=limit).collect()
        assert sorted((r.doc_id, r.item_id) for r in rows) == (
            [(i, 2) for i in range(8)] + [(20, 1), (21, 1), (26, 2), (28, 2)])
        by = {r.doc_id: r for r in rows}
        assert by[20].n_renamed == 0 and by[21].n_renamed == 3 and by[21].n_slots >= 6
    kept = D.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 22, 23, 24, 25, 27]
    assert D.contaminated(docs.limit(0), items).collect() == []
    assert D.contaminated(docs, items.limit(0)).collect() == []


def test_long_part_of_an_item(make_docs, items):
    part = " ".join(PLAIN.split()[:13])
    shorter = " ".join(PLAIN.split()[:9])
    rows = D.contaminated(make_docs({1: pad(part), 2: pad(shorter)}), items, share=0.9).collect()
    assert [r.doc_id for r in rows] == [1]


def test_placeholders(spark):
    row = spark.createDataFrame([("He met Mary, paid 1,200.50 dollars and ran 7km. Then Tom sat",)],
                                "text string").select(D.valued("text").alias("v"))
    words = row.first().v
    assert words == ["he", "met", "\x02mary", "paid", "\x01120050", "\x03dollars", "and", "ran",
                     "\x017", "\x03km", "then", "\x02tom", "sat"]
    shape = row.select(D.template(row["v"]).alias("t")).first().t
    assert shape[2:6] == ["\x02", "paid", "\x01", "\x03"]


def test_no_python_in_the_plan(make_docs, items):
    plan = D.contaminated(make_docs({1: "a"}), items)._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan


WORDS = "Silver ants carry warm bread over green hills while nobody counts their slow brown steps".split()


def edited(words, places):
    return " ".join(f"edit{k}".rstrip("0123456789") + "xyz"[k % 3] if k in places else w
                    for k, w in enumerate(words))


def lower_pad(text, n):
    return " ".join(["plain"] * n) + " " + text + " after it all"


def test_every_offset_with_one_and_two_edits(spark, make_docs):
    items = spark.createDataFrame([(15, " ".join(WORDS))], "item_id long, text string")
    cases = [(n, places) for n in range(6) for k in (1, 2)
             for places in itertools.combinations(range(15), k)]
    docs = make_docs({i: lower_pad(edited(WORDS, p), n) for i, (n, p) in enumerate(cases)})
    rows = D.contaminated(docs, items).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(cases)))
    assert all(r.start == cases[r.doc_id][0]
               and r.n_matched == 15 - len(cases[r.doc_id][1]) for r in rows)


@pytest.mark.parametrize("share", [0.6, 0.8, 0.3])
def test_as_many_edits_as_the_rule_accepts(spark, make_docs, share):
    g = random.Random(5)
    vocabulary = [a + b for a in "bdfgklmn" for b in ("arn", "ell", "int", "oss", "urk", "ymp")]
    items = {n: g.sample(vocabulary, n) for n in (6, 7, 8, 9, 10, 11, 12, 13, 20, 27, 33)}
    table = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()],
                                  "item_id long, text string")
    docs, wanted = {}, set()
    for n, w in items.items():
        for _ in range(30):
            k = next(m for m in range(n + 1) if n - m - 1 < share * n)  # edits that are accepted
            i = len(docs)
            docs[i] = lower_pad(edited(w, g.sample(range(n), k)), g.randrange(9))
            wanted.add((i, n))
        if n == 10:
            docs[len(docs)] = lower_pad(edited(w, (3, 4, 5, 6)), 4)
            wanted |= {(len(docs) - 1, n)} if share <= 0.6 else set()
    found = {(r.doc_id, r.item_id) for r in D.contaminated(make_docs(docs), table,
                                                            share=share).collect()}
    assert wanted <= found


def test_short_items_after_a_lower_case_word(spark, make_docs):
    items = spark.createDataFrame([(n, " ".join(WORDS[:n])) for n in range(6, 13)]
                                  + [(50, "Minutes count when old clocks stop again")],
                                  "item_id long, text string")
    cases = [(i, n) for n in range(6, 13) for i in range(6)]
    docs = make_docs({k: lower_pad(" ".join(WORDS[:n]), i) for k, (i, n) in enumerate(cases)}
                     | {900: "he waited 5 minutes count when old clocks stop again"})
    found = {(r.doc_id, r.item_id): r for r in D.contaminated(docs, items).collect()}
    for k, (i, n) in enumerate(cases):
        assert found[k, n].n_matched == n and found[k, n].start == i
    assert found[900, 50].n_matched == 7
