"""Alias classes of urls: chains, cycles, hubs, long urls and random graphs, against plain Python."""

import random

import pytest

from kymora.llm import url_filter

RULES = [("block", "bad.test", "/"), ("allow", "good.test", "/"), ("block", "mixed.test", "/x/"), ("allow", "mixed.test", "/x/y/")]


def plain_verdicts(pages):
    """Verdict of each url, over links (url, target) and urls alone; all have a host and no query."""
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    def rule(url):
        host, _, path = url.split("://", 1)[1].partition("/")
        fits = [(len(h + p), a == "allow", a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        return max(fits)[2] if fits else None

    for url, target in pages:
        for u in filter(None, (url, target)):
            host, _, path = u.split("://", 1)[1].partition("/")
            parent[root(("form", host.removeprefix("www.") + ("/" + path).removesuffix("/")))] = root(u)
        if target:
            parent[root(target)] = root(url)
    groups = {}
    for u in list(parent):
        if isinstance(u, str):
            groups.setdefault(root(u), []).append(u)
    out = {}
    for members in groups.values():
        said = {rule(u) for u in members}
        for u in members:
            out[u] = rule(u) or ("block" if "block" in said and "allow" not in said else "allow")
    return out


def judged(spark, pages):
    rows = [(i, u, f'<link rel="canonical" href="{t}">' if t else None, 0) for i, (u, t) in enumerate(pages)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, a int")
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    return {pages[r.page_id][0]: r.verdict for r in url_filter.judge(table, rules).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_random_links(spark, seed):
    rng = random.Random(seed)
    hosts = ["a.test", "www.a.test", "b.test", "c.test", "good.test", "www.bad.test", "mixed.test"]
    urls = [f"{rng.choice(['http', 'https'])}://{rng.choice(hosts[:4] * 6 + hosts)}/{rng.choice('xyz')}/{rng.choice('xyz')}{i}{rng.choice(['', '/'])}" for i in range(150)]
    pages = [(u, rng.choice(urls) if rng.random() < 0.4 else None) for u in urls]
    want = plain_verdicts(pages)
    assert judged(spark, pages) == {u: want[u] for u, _ in pages}


def test_chains_cycles_hubs_and_long_urls(spark):
    chain = [(f"http://c.test/{i}", f"http://c.test/{i + 1}") for i in range(120)] + [("http://c.test/120", "http://bad.test/end")]
    cycle = [(f"http://d.test/{i}", f"http://d.test/{(i + 1) % 30}") for i in range(30)]
    hub = [(f"http://h{i}.test/", "http://bad.test/hub") for i in range(500)]
    both = [(f"http://k{i}.test/", "http://m.test/hub") for i in range(200)] + [("http://m.test/hub", "http://bad.test/a"), ("http://k7.test/", "http://good.test/b")]
    long = [("http://e.test/" + "p" * 100_000, "http://bad.test/" + "q" * 100_000)]
    pages = [*chain, *cycle, *hub, *both, *long]
    got = judged(spark, pages)
    want = plain_verdicts(pages)
    assert got == {u: want[u] for u, _ in pages}
    assert {got[u] for u, _ in chain} == {"block"} == {got[u] for u, _ in hub} and {got[u] for u, _ in cycle} == {"allow"}


def test_a_url_that_reads_like_a_canonical_form(spark):
    """The text ``x.net/es/5`` is no alias of the url whose canonical form it is."""
    rows = [(1, "http://www.x.net/es/5/", None), (2, "x.net/es/5", None), (3, "https://x.net/es/5", None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = spark.createDataFrame(url_filter.RULES, "action string, host string, path string")
    got = {r.page_id: (r.host, r.rule, r.verdict, r.alias) for r in url_filter.judge(table, rules).collect()}
    assert got[2] == ("", None, "allow", "x.net/es/5") and got[1][3] == got[3][3] == "http://www.x.net/es/5/"
    assert got[1][1:3] == ("net/es/", "block")
