import numpy as np
import pytest

from gridmason.llm import topk, urlfilter

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def best(rows, k, mod):
    ok = [(i, np.floor(1024 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(ok):
        if q % mod == 0:
            s = sorted((-int(x @ y), i) for b, (i, y) in enumerate(ok) if a != b and len(x) == len(y))[:k]
            out += [(q, r + 1, i, -n) for r, (n, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("case", ["random", "ties", "few", "empty", "odd"])
def test_top_k(spark, case):
    r = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=8)]) for i in range(400)]
    if case == "ties":
        rows = [(i, rows[0][1] if i % 3 else v) for i, v in rows]
    if case == "few":
        rows = rows[:4]
    if case == "empty":
        rows = []
    if case == "odd":
        rows += [(1000, None), (1001, []), (1002, [1.0] * 7 + [None]), (1003, [float("nan")] * 8), (1004, [float("inf")] * 8), (1005, [1.0, 2.0]), (1040, [3.0, 1.0]), (1060, [0.5]), (None, [1.0] * 8), (20, [9.0] * 8), (20, [9.0] * 8), (2000, [0.0] * 8), (2020, [1000.0] * 8)]
    df = spark.createDataFrame([(i, v, 3, "c") for i, v in rows], "vec_id long, embedding array<float>, cell int, score string").repartition(3)
    got = topk.top_k(df, k=10, query_mod=20, n_pivots=6, bands=4, block_rows=50, block_queries=7, sample=100)
    assert sorted(tuple(x) for x in got.collect()) == best(rows, 10, 20)


def verdicts(spark, rows, **more):
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, host string").repartition(2)
    return {r["page_id"]: r for r in urlfilter.judge(df, RULES, **more).collect()}


def test_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x", "http://a.example.com/en/x?q#f", "http://example.com/enx", "http://example.com", "https://x.net/es/", "https://x.net/es", "http://notexample.com/en/", "http://x.org/en/", "ftp://u@h.net/fr/?a", "http://xnet/es/"]
    got = verdicts(spark, [(i, u, None) for i, u in enumerate(urls)])
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(len(urls))] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("a.example.com", "/en/x", "example.com/en/", "block"), ("example.com", "/enx", "com/", "allow"), ("example.com", "", None, "allow"), ("x.net", "/es/", "net/es/", "block"),
        ("x.net", "/es", None, "allow"), ("notexample.com", "/en/", "com/", "allow"), ("x.org", "/en/", None, "allow"), ("u@h.net", "/fr/", "net/fr/", "block"), ("xnet", "/es/", None, "allow"),
    ]


def test_blocks_reach_aliases(spark):
    rows = [
        (1, "http://a.org/1", "<head><link href='http://b.org/2' rel=canonical></head>"), (2, "http://b.org/2", '<meta http-equiv="refresh" content="0; url=//c.net/fr/3">'), (3, "http://d.org/", '<link rel="canonical" href="/1">'),
        (4, "http://a.com/x", "<link rel='canonical' href='http://c.net/fr/3'>"), (5, "https://a.org/1?utm_source=z#top", None), (6, "http://e.org/p/q", "<link rel=canonical href=r>"), (7, "http://e.org/p/r", None), (8, "http://f.org/", None), (8, "http://f.org/", None),
    ]
    got = verdicts(spark, rows)
    assert [got[i]["verdict"] for i in range(1, 9)] == ["block", "block", "allow", "allow", "block", "allow", "allow", "allow"]
    assert got[1]["propagated"] and not got[4]["propagated"]
    more = spark.createDataFrame([("http://e.org/p/r", "http://x.net/es/"), ("http://zz.org/", None)], "source string, target string")
    got = verdicts(spark, rows, redirects=more)
    assert [got[i]["verdict"] for i in (6, 7, 8)] == ["block", "block", "allow"]


def test_no_pages(spark):
    assert verdicts(spark, []) == {}
