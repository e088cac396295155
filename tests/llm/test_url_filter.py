import re

from weftline.llm import url_filter as U
from weftline.llm.graph import components


def judge(spark, rows, **more):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r for r in U.judge_urls(df, **more).collect()}


def test_random_rules_by_brute_force(spark):
    """The longest rule whose host the url's host is, or is a subdomain of, and whose path its path starts with."""
    import random

    rng = random.Random(3)
    hosts, paths = ["com", "a.com", "b.a.com", "net", "x.net", "a.net"], ["/", "/a", "/a/b", "/a/bc", "/b/", ""]
    rules = sorted({(rng.choice(hosts), rng.choice(paths)) for _ in range(14)})
    rules = [(h, p, rng.choice(["block", "allow"])) for h, p in rules]
    urls = [f"http://{rng.choice(['', 'www.', 'a.', 'xa.'])}{rng.choice(hosts)}{rng.choice(['/', '/a', '/a/b/c', '/a/bcd?x', '/b', '#f', ''])}" for _ in range(300)]
    got = judge(spark, [(i, u, None) for i, u in enumerate(urls)], rules=rules)
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = rest[:cut], re.split("[?#]", rest[cut:])[0]
        fits = [(h, p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0]], [-ord(c) for c in r[1]]), default=None)
        assert (got[i].host, got[i].path) == (host, path) and (got[i].rule, got[i].verdict) == ((best[0] + best[1], best[2]) if best else (None, "allow")), u


def test_clashing_columns(spark):
    import fixtures_llm as fx
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "http://com/en/", None), (2, None, None)], "page_id long, url string, html string")
    more = df.withColumns({c: F.lit("x") for c in (*fx.CLASHING, "node", "component", "host", "path", "rule", "verdict", "a", "b")})
    assert sorted((r.page_id, r.verdict) for r in U.judge_urls(more).collect()) == [(1, "block"), (2, "allow")]


def test_hosts_paths_and_rules(spark):
    got = judge(spark, [
        (1, "HTTP://A.Example.COM/en/7x?q#f", None), (2, "https://x.com/en/1", ""), (3, "http://net/de/1", None), (4, "http://w.example.net/de/85", None), (5, "http://fexample.net/de/8", None),
        (6, None, None), (7, "nothing", None), (8, "ftp://o.org", None), (9, "http://org/es/?a", None), (10, "http://com?x/en/", None), (11, "http://a://b/en/", None), (12, "http://É.COM/en/", None),
    ])
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(1, 13)] == [
        ("a.example.com", "/en/7x", "example.com/en/7", "allow"), ("x.com", "/en/1", "com/en/", "block"), ("net", "/de/1", "net/de/", "allow"), ("w.example.net", "/de/85", "example.net/de/8", "block"),
        ("fexample.net", "/de/8", "net/de/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("o.org", "", None, "allow"), ("org", "/es/", "org/es/", "block"), ("com", "", None, "allow"), ("a:", "//b/en/", None, "allow"), ("É.com", "/en/", "com/en/", "block"),
    ]


def test_aliases_take_decisions(spark):
    got = judge(spark, [
        (1, "http://a.com/en/x", '<link rel="canonical" href="https://Z.fr/q?a=1&amp;b=2">'), (2, "https://z.fr/q?a=1&b=2#top", None), (3, "http://q.fr/1", "<META HTTP-EQUIV=refresh content='0; url=/2'>"),
        (4, "http://q.fr/2", "<link href=http://r.fr rel=canonical>"), (5, "http://r.fr/", '<link rel=canonical href="//www.example.com/en/77">'), (6, "http://s.fr/d/e", '<link rel="canonical" href="f">'), (7, "http://s.fr/d/f", None),
        (8, "http://s.fr/d/f", '<link rel="stylesheet" href="http://a.com/en/x">'), (9, "http://t.fr/", '<link rel="canonical" href="">'), (10, "http://u.fr/1", '<link rel=canonical href="http://b.org/es/1"><link rel=canonical href="http://net/de/1">'),
    ])
    assert [got[i].verdict for i in range(1, 11)] == ["block", "block", "allow", "allow", "allow", "allow", "allow", "allow", "allow", "allow"]
    assert got[6].component == got[7].component and got[2].component == got[1].component and got[9].component is None
    redirects = spark.createDataFrame([("http://m.fr/", "http://b.org/es/1"), (None, "x")], "from_url string, to_url string")
    assert judge(spark, [(1, "http://m.fr", None)], redirects=redirects)[1].verdict == "block"


def test_components_match_union_find(spark):
    import random

    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(170)] + [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("hub", f"l{i}") for i in range(50)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {x: find(x) for x in parent}


def test_empty(spark):
    assert judge(spark, []) == {}
