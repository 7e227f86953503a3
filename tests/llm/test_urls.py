import pytest
from pyspark.sql import functions as F

from flowguard.llm import url_filter as U
from flowguard.llm.q_urls import RULES

URLS = [
    ("http://a.Example.ORG/es/x?q#f", "a.example.org", "/es/x", "example.org/es/", "block"),
    ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("https://x.com/fr/1", "x.com", "/fr/1", "com/fr/", "allow"),
    ("https://x.com/de/1", "x.com", "/de/1", "com/de/", "block"),
    ("https://x.org", "x.org", "", None, None),
    ("https://x.org?a/b", "x.org", "", None, None),
    ("no scheme.org/es/", "", "", None, None),
    ("", "", "", None, None), (None, "", "", None, None),
    ("http://a.net/p://b.org/", "a.net", "/p://b.org/", None, None),
    ("http://" + "long." * 5000 + "org/x", "long." * 5000 + "org", "/x", "org/", "allow"),
]


@pytest.fixture
def pages(spark):
    rows = [(i, u, "<p>", "x", "x") for i, (u, *_) in enumerate(URLS)]
    more = [(100 + i, f"http://s{i % 7}.com/{'fr' if i % 2 else 'de'}/{i}?a=1", "", "x", "x")
            for i in range(60)]
    return spark.createDataFrame(rows + more + more[:2] + [(None, "http://q.net/", "", "x", "x")],
                                 "page_id long, url string, html string, host string, y string")


def test_hosts_paths_and_rules(pages):
    got = U.judge(pages, RULES, trees=3, depth=2)
    rows = {r.page_id: r for r in got.collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        r = rows[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict in ({verdict} if verdict else {"allow", "block"})
        assert 0 <= r.score <= 1
    assert got.count() == pages.count() and None in rows


def test_trees_learn_given_labels(spark, pages):
    labels = spark.createDataFrame(
        [(f"http://good{i}.net/a/{i}", 0) for i in range(60)]
        + [(f"http://b4d-{i}-win.biz/{i * 7919}?x={i}&y=2", 1) for i in range(60)],
        "url string, y int")
    asked = spark.createDataFrame([(1, "http://good7.net/b/3"), (2, "http://b4d-9-win.biz/4?x=1&y=3")],
                                  "page_id long, url string")
    got = {r.page_id: r.verdict for r in U.judge(asked, (), labels, trees=5, depth=3).collect()}
    assert got == {1: "allow", 2: "block"}


def test_one_class_and_empty_table(spark, pages):
    only = U.judge(pages, RULES[:1])
    assert {r.verdict for r in only.collect()} == {"allow"}
    assert U.judge(pages.limit(0), RULES).collect() == []
    assert U.judge(pages, ()).filter("verdict <> 'allow'").count() == 0


def test_features(spark):
    row = U.lexical(U.parsed(spark.createDataFrame([(1, "http://a-b.c.net/x/y?p=1&q=22#z")],
                                                   "page_id long, url string"), ())).first()
    assert (row.depth, row.n_params, row.n_hyphens, row.has_fragment) == (2, 2, 1, 1)
    assert row.site == "c.net" and row.suffix == "net" and row.host_labels == 2
    flat = spark.createDataFrame([(1, "abab")], "page_id long, url string")
    assert U.lexical(U.parsed(flat, ())).select(F.round("entropy", 6)).first()[0] == 1.0
