from graphloom.llm.url_filters import automaton, count_terms, filter_urls

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "Sub.Example.net", ""), ("allow", "org", "/fr/a")]
URLS = [
    "http://a.net/x", "http://a.net", "http://net/", "http://xnet/", "https://www.Example.NET/en/1?x=http://b.org/fr/", "http://example.net/EN/1", "http://m.example.com/de/",
    "http://example.org/fr/ab#t", "http://sub.example.net/en/", "http://example.org?/fr/", "no scheme net/", "", None, "ftp://user@host:80/p", "://", "a://b://c/d",
    "http://free-cheap.example.com/", "http://freecheap.example.com/", "http://free-free.example.com/", "http://porn.example.org/fr/", "http://porn.example.org/", "http://pornó.example.org/",
    "http://x.com/" + "a." * 50_000 + "xxx", "http://" + "a." * 3000 + "org/fr/", "http://a.net/x",
]


def brute(url, rules, strict, soft, min_soft):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(c.lower() if c < "\x80" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), len(h), a == "block", h.lower() + p, a) for a, h, p in rules if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    low, n, kinds = "".join(c.lower() if c < "\x80" else c for c in url or ""), 0, set()
    inside = lambda c: c.isascii() and c.isalnum() or c > "\x7f"
    for t in {*strict, *soft}:
        for i in range(len(low)):
            if low.startswith(t, i) and not (i and inside(low[i - 1])) and not (i + len(t) < len(low) and inside(low[i + len(t)])):
                n += t in strict
                if t not in strict:
                    kinds.add(t)
    verdict = "block" if n or len(kinds) >= min_soft else "allow"
    return host, path, max(fits)[3] if fits else None, n, len(kinds), max(fits)[4] if fits else verdict


def test_against_brute_force_inline_and_joined(spark):
    strict, soft = ["porn", "xxx"], ["free", "cheap", "de", "porn"]
    pages = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    want = {k: brute(u, RULES, strict, soft, 2) for k, u in enumerate(URLS)}
    table = spark.createDataFrame(RULES, "action string, host string, path string")
    for rules in (RULES, table):
        out = filter_urls(pages, rules, strict, soft, 2).selectExpr("row.page_id AS k", "host", "path", "rule", "n_strict", "n_soft", "verdict").collect()
        assert len(out) == len(URLS)
        assert {r.k: tuple(r)[1:] for r in out} == want


def test_terms_and_boundaries():
    found = automaton(("a-b",), ("b", "b-c"))
    assert count_terms("a-b-c b", found) == (1, 2)
    assert count_terms("xa-b", found) == (0, 1)
    assert count_terms("", found) == (0, 0)
    assert len(automaton((), ())) == 0


def test_empty_table_and_no_rules(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert filter_urls(empty, RULES).collect() == []
    assert filter_urls(empty, spark.createDataFrame([], "action string, host string, path string")).collect() == []
    one = spark.createDataFrame([(1, "http://casino.example/")], "page_id long, url string")
    assert [r.verdict for r in filter_urls(one).collect()] == ["block"]
    assert [r.verdict for r in filter_urls(one, [], [], []).collect()] == ["allow"]
