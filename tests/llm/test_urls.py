import random

import pytest
from helpers import plan

from tallyloom.llm import urls
from tallyloom.llm.catalog import URL_RULES
from tallyloom.plans.small import literal_table

PAGES = "page_id long, url string, html string, verdict string, host string"


@pytest.fixture
def rules(spark):
    return literal_table(spark, URL_RULES, "host string, path string, verdict string")


def judged(spark, rows, rules, **more):
    pages = spark.createDataFrame([(i, u, h, "old", "old") for i, u, h in rows], PAGES)
    return {r["page_id"]: r for r in urls.judge_urls(pages, rules, **more).collect()}


@pytest.mark.parametrize("url,host,path,rule,verdict", [
    ("http://EXAMPLE.com/en/1?x#y", "example.com", "/en/1", "example.com/en/", "block"),
    ("https://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("https://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
    ("http://example.com", "example.com", "", None, "allow"),
    ("http://x.net/es/a", "x.net", "/es/a", "net/es/", "block"),
    ("http://x.net/ES/a", "x.net", "/ES/a", None, "allow"),
    ("http://net?q=/es/", "net", "", None, "allow"),
    ("ÄB://É.NET/fr/#", "É.net", "/fr/", "net/fr/", "block"),
    ("no scheme.net/es/", "", "", None, "allow"),
    ("a://b://c.net/es/", "b:", "//c.net/es/", None, "allow"),
    (None, "", "", None, "allow"), ("", "", "", None, "allow"),
])
def test_rules(spark, rules, url, host, path, rule, verdict):
    r = judged(spark, [(1, url, None)], rules)[1]
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def test_aliases_take_over_blocks_unless_one_is_allowed(spark, rules):
    link = '<LINK href="%s" rel="canonical">'
    pages = [(1, "http://a.org/x", link % "http://b.net/es/1"),                  # alias of a blocked url, which is no row
             (2, "http://c.org/x", '<meta http-equiv="refresh" content="0; url=//a.org/x">'),  # alias of an alias
             (3, "http://d.org/1", link % "/2"), (4, "http://d.org/2", link % "http://b.net/fr/9"),
             (5, "http://e.org/1", link % "http://f.com/1"), (6, "http://e.org/1?x=1", link % "http://g.net/es/1"),
             (7, "http://e.org/1", link % "http://g.net/es/1"),                   # aliases with an allowed and a blocked one
             (8, "http://f.com/1", link % "http://a.org/x"),                      # allowed by its own rule
             (9, "http://lone.org/", None)]
    got = judged(spark, pages, rules)
    assert {k: r["verdict"] for k, r in got.items()} == {
        1: "allow", 2: "allow", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow"}
    blocked = judged(spark, pages[:4], rules)
    assert {k: r["verdict"] for k, r in blocked.items()} == {1: "block", 2: "block", 3: "block", 4: "block"}
    assert {r["decided_by"] for r in blocked.values()} == {"alias"}


def test_redirect_table_and_odd_rows(spark, rules):
    moved = spark.createDataFrame([("http://a.org/1", "http://b.net/es/"), (None, "x"), ("http://a.org/1", None)],
                                  "src string, dst string")
    got = judged(spark, [(1, "http://a.org/1#top", None), (1, "http://a.org/1", ""), (None, "http://q.org/", "<link>")], rules,
                 redirects=moved, html=None)
    assert got[1]["verdict"] == "block" and got[None]["verdict"] == "allow"
    assert judged(spark, [], rules) == {}
    assert judged(spark, [(1, "http://x.net/es/", None)], rules.limit(0))[1]["verdict"] == "allow"


def test_long_hosts_and_paths(spark, rules):
    got = judged(spark, [(1, "http://" + "a." * 20_000 + "net/es/" + "x" * 100_000, None)], rules)
    assert got[1]["rule"] == "net/es/"


def test_components_against_a_walk(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(0, k) for k in range(1000, 1200)]
    edges += [(k, k + 1) for k in range(2000, 2100)]
    got = {r["node"]: r["component"] for r in
           urls.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in parent}


def test_no_python_in_the_plan(spark, rules):
    pages = spark.createDataFrame([(1, "http://a.org/x", "", "", "")], PAGES)
    assert "Python" not in plan(urls.judge_urls(pages, rules))
