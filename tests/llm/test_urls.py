from __future__ import annotations

import os
import random
from collections import Counter
from urllib.parse import urljoin

import duckdb
from pyspark.sql import functions as F

from attest.llm import urls
from attest.llm.common import min_components


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def canonical(to: str) -> str:
    return f'<html><head><link rel="canonical" href="{to}"></head></html>'


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:at], rest[at:]
    cut = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:cut]


def plain_rule(url):
    host, path = split(url)
    fit = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def test_rules_against_python(spark):
    r = random.Random(1)
    hosts = ["net", "a.net", "example.net", "x.example.net", "EXAMPLE.com", "notexample.com", "a.example.com", "org", "b.org", "borg", "", "éxample.net", "x.com:80"]
    paths = ["", "/", "/en/", "/en", "/de/x", "/fr/?q=/de/", "/fr/#x", "?a=/en/", "#/en/", "/x/../en/"]
    rows = [(i, f"{r.choice(['http', 'https', ''])}://{h}{p}", None) for i, (h, p) in enumerate((h, p) for h in hosts for p in paths)]
    rows += [(900, None, None), (901, "example.net/en/", None), (902, "", None), (903, "a://b://net/", None), (904, "http://example.com/de/", None)]
    for x in urls.query(pages(spark, rows)).collect():
        url = dict((i, u) for i, u, _ in rows)[x.page_id]
        rule, verdict = plain_rule(url)
        assert (x.host, x.path, x.rule, x.verdict) == (*split(url), rule, verdict or "allow"), url


def test_blocks_spread_over_aliases_and_an_allow_stops_them(spark):
    rows = [
        (1, "https://a.com/x", canonical("https://bad.net/x")),
        (2, "https://b.com/y", '<meta http-equiv="refresh" content="0; url=https://A.com/x">'),
        (3, "https://c.com/z", canonical("/w")),
        (4, "https://c.com/w", canonical("https://bad.net/w")),
        (5, "https://d.com/q", canonical("https://bad.net/q")),
        (6, "https://e.org/fr/q", canonical("https://d.com/q")),
        (7, "https://f.com/", None),
        (8, "https://bad.net/x#part", None),
        (9, "https://a.com/x#part", None),
        (9, "https://a.com/x#part", None),
        (None, "https://a.com/x", None),
    ]
    found = Counter((r.page_id, r.verdict) for r in urls.query(pages(spark, rows)).collect())
    assert found == Counter({(1, "block"): 1, (2, "block"): 1, (3, "block"): 1, (4, "block"): 1, (5, "allow"): 1, (6, "allow"): 1, (7, "allow"): 1, (8, "block"): 1, (9, "block"): 2, (None, "block"): 1})
    assert urls.query(pages(spark, [])).count() == 0


def test_components_of_random_graphs_stars_and_chains(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5000 - i, 4999 - i) for i in range(60)]
    edges = [e for e in edges if e[0] != e[1]]
    root: dict[int, int] = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in min_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: top(x) for x in {n for e in edges for n in e}}
    assert min_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_sql_gives_the_same(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{os.path.join(sf, 'pages.parquet')}'")
    want = Counter(con.sql(urls.ORACLE).fetchall())
    got = urls.query(spark.read.parquet(f"{sf}/pages.parquet"))
    assert got.columns == con.sql(urls.ORACLE).columns and Counter(map(tuple, got.collect())) == want


LINKED = [
    (1, "https://a.com/x", canonical("https://bad.net/x")),
    (2, "https://b.com/y", '<meta http-equiv="refresh" content="0; url=https://A.com/x">'),
    (3, "https://c.com/z", canonical("/w")),
    (4, "https://c.com/w", canonical("https://bad.net/w")),
    (5, "https://d.com/q", canonical("https://bad.net/q")),
    (6, "https://e.org/fr/q", canonical("https://d.com/q")),
    (7, "https://f.com/", None),
    (8, "https://bad.net/x#part", ""),
    (9, "https://a.com/x#part", None),
    (9, "https://a.com/x#part", None),
    (None, "https://a.com/x", None),
    (10, "https://g.com/1", canonical("https://unseen.net/1")),
    (11, "https://h.com/a/b/c?q=1", canonical("../../i/./j")),
    (12, "https://h.com/i/j", "<link rel=canonical href=//k.NET/>"),
    (13, "https://l.com/a", "<link rel='alternate' href=/nothing><LINK REL='nofollow canonical' HREF='b?x=1&amp;y=2#f'><link rel=canonical href=/c>"),
    (14, "https://l.com/b?x=1&y=2", None),
    (15, "https://l.com/c", canonical("https://z.net/c")),
    (16, "https://m.com", canonical("mailto:x@y.net")),
    (17, "https://m.com/p", canonical("?page=2")),
    (18, "https://m.com/p?page=2", canonical("https://n.net/p")),
    (19, "no scheme", canonical("https://n.net/p")),
    (20, "https://o.com/p/", canonical("#top")),
    (21, "https://o.com/q/r", canonical("..")),
    (22, "https://o.com/", canonical("https://n.net/o")),
    (23, None, canonical("https://n.net/p")),
    (24, "https://M.com/p", "<link href='https://n.net/p'>"),
]


def test_sql_follows_links_too(spark):
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", LINKED)
    want = Counter(con.sql(urls.ORACLE).fetchall())
    assert Counter(map(tuple, urls.query(pages(spark, LINKED)).collect())) == want
    blocked = {i for i, _, _, _, verdict in want if verdict == "block"}
    assert blocked == {1, 2, 3, 4, 8, 9, None, 10, 11, 12, 13, 14, 15, 17, 18, 21, 22, 24}


def test_links_are_resolved_as_python_resolves_them(spark):
    r = random.Random(3)
    bases = ["https://a.com/b/c/d?q=1", "http://a.com", "https://a.com/", "https://a.com/x/", "https://a.com/x/../y"]
    links = ["", "#f", "g", "./g", "g/", "/g", "//h.com/g", "?y", "g?y/./x", "../g", "../../../g", "..", ".", "./", "../", "g/../h", "https://x.net/a", "mailto:a@b", "/./g/../h/.", "a/b/./c#x"]
    rows = [(u, x + r.choice(["", "#frag"])) for u in bases for x in links]
    df = spark.createDataFrame(rows, "url string, link string").select("url", "link", urls.resolved(F.col("url"), F.col("link")).alias("to"))
    for x in df.collect():
        want = urljoin(x.url, x.link).split("#")[0]
        if x.link.split("#")[0] == "":
            assert x.to is None
        elif ".." in x.url and x.link.startswith("?"):
            continue
        else:
            assert x.to == want, (x.url, x.link)


def test_very_long_pages_and_other_columns(spark):
    long = [("<link " * 100_000), "<meta content='" + "url " * 100_000, "<link rel=" + "rel=" * 100_000 + ">", "word " * 200_000 + canonical("https://x.net/")]
    rows = [(i, f"https://y{i}.com/", h, "h", "p", True) for i, h in enumerate(long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, name string, blocked boolean")
    assert {(r.page_id, r.host, r.verdict) for r in urls.query(df).collect()} == {(0, "y0.com", "allow"), (1, "y1.com", "allow"), (2, "y2.com", "allow"), (3, "y3.com", "block")}
