"""Url verdicts against a plain walk over the alias graph."""

from __future__ import annotations

import random
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

from seriesloom.llm.common import connected_components
from seriesloom.llm.urls import OP9_SQL, alias_edges, judge_urls, op9_url_filter
from tests.oracle import difference

RULES = (("block", "com", "/en/"), ("allow", "com", "/en/7"), ("block", "org", "/"))


def canonical(to: str) -> str:
    return f'<html><link rel="canonical" href="{to}"></html>'


def plain(rows: list[tuple[int, str, str | None]], edges: list[tuple[str, str]]) -> dict[int, tuple[str, str | None]]:
    def rule(url: str) -> str | None:
        host, _, path = url.split("://")[1].partition("/")
        fits = [(len(h + p), v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        return max(fits)[1] if fits else None

    out = {}
    for page, url, _ in rows:
        reach, todo = {url}, [url]
        while todo:
            at = todo.pop()
            near = {b for a, b in edges if a == at} | {a for a, b in edges if b == at}
            todo += near - reach
            reach |= near
        found = {rule(u) for u in reach}
        spread = "block" if "block" in found and "allow" not in found else "allow"
        out[page] = (rule(url) or spread, min(reach) if len(reach) > 1 else None)
    return out


def test_verdicts_spread_to_and_from_the_smallest_url(spark):
    links = [
        ("http://a.com/en/1", None), ("http://b.net/x", "http://a.com/en/1"),  # the root blocks
        ("http://c.net/x", "http://d.com/en/2"), ("http://d.com/en/2", None),  # the root is blocked
        ("http://e.net/1", "http://f.net/2"), ("http://f.net/2", "http://g.com/en/3"), ("http://g.com/en/3", "http://h.com/en/7"), ("http://h.com/en/7", None),
        ("http://i.net/1", "http://j.net/1"), ("http://j.net/1", "http://k.net/1"), ("http://k.net/1", "http://l.org/"), ("http://l.org/", None),
        ("http://m.net/", None), ("http://n.net/1", "http://b.org/no-page"),
    ]
    rows = [(n, u, canonical(to) if to else "<html></html>") for n, (u, to) in enumerate(links)]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()
    assert len(got) == len(rows)
    assert {r.page_id: (r.verdict, r.component) for r in got} == plain(rows, [e for e in links if e[1]])


def test_edges_of_all_tags_and_relative_targets(spark):
    page = "https://A.com/d/e/p.html?q=1"
    far = {
        "page2.html": "https://a.com/d/e/page2.html", "?id=3": "https://a.com/d/e/p.html?id=3", "../x": "https://a.com/d/x", "../../../y/": "https://a.com/y/",
        ".": "https://a.com/d/e/", "//B.net/x": "https://b.net/x", "/r/./s?t=../u": "https://a.com/r/s?t=../u", "#top": "https://a.com/d/e/p.html", "a?u=http://x.y": "https://a.com/d/e/a?u=http://x.y",
        "HTTP://C.org/z": "http://c.org/z", "/q?a=1&amp;b=2": "https://a.com/q?a=1&b=2",
    }
    pad = f'data-x="{"y" * 5000}"'
    html = "".join(f'<link {pad} rel=canonical {pad} href="{to}">' for to in far) + '<link rel=canonical href="mailto:a@b.c"><link rel=icon href="no">'
    html += '<meta http-equiv="refresh" content="0; url=one"><META http-equiv=refresh content="1;URL=two">'
    rows = [(1, page, html), (2, "http://d.com", '<link rel=canonical href="x">')]
    got = alias_edges(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    me = "https://a.com/d/e/p.html?q=1"
    want = [(me, to) for to in [*far.values(), "https://a.com/d/e/one", "https://a.com/d/e/two"]] + [("http://d.com/", "http://d.com/x")]
    assert sorted(map(tuple, got)) == sorted(want)


class Tags(HTMLParser):
    """Targets as a browser's parser reads them."""

    def __init__(self, html: str):
        super().__init__()
        self.base, self.found = None, []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        a: dict = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        if tag == "base" and "href" in a and self.base is None:
            self.base = a["href"]
        if tag == "link" and "canonical" in a.get("rel", "").lower().split() and a.get("href"):
            self.found.append(a["href"])
        if tag == "meta" and a.get("http-equiv", "").strip().lower() == "refresh":
            self.found += re.findall(r"(?i)\burl\s*=\s*[\"']?([^\"']+)", a.get("content", ""))[:1]


def node(url: str) -> str:
    u = urlsplit(url)
    host = u.netloc.lower()
    for scheme, port in (("http", "80"), ("https", "443")):
        if u.scheme.lower() == scheme:
            host = host.removesuffix(f":{port}").removesuffix(":")
    return f"{u.scheme.lower()}://{host}{u.path or '/'}" + (f"?{u.query}" if u.query else "")


TO = "http://s.com/en/1"
PAGES = [
    f'<link data-href="{TO}" rel="canonical" href="http://own.fr/p">', f'<!-- <link rel=canonical href="{TO}"> --><p>', f'<link rel=canonicalish href="{TO}">', f'<link rel="alternate canonical" href="{TO}">',
    f'<link title="a>b" rel=canonical href="{TO}">', '<base href="http://s.com/en/"><link rel=canonical href="1">', '<base target=_top><base href="/x/"><base href="/y/"><link rel=canonical href="1">', '<link rel=canonical href="http://S.com:80/en/1">',
    '<link rel=canonical href="https://s.com:443">', '<link rel=canonical href="http://s.com:8080?a=1">', '<link rel=canonical href="http://h.xx">', '<link rel=canonical href="/a?b=1&#38;amp;c=2">', "<LINK HREF='x' REL='CANONICAL'/>",
    f"<script>var t='<link rel=canonical href={TO}>';</script>", f"<style>/* <link rel=canonical href={TO}> */</style><link rel=canonical href=after>", f"<title>x</title><linkx rel=canonical href={TO}>", '<link rel=canonical href="">', "<link rel=canonical>",
    f"<meta http-equiv='refresh' content='0; url={TO}'>", '<meta http-equiv=refresh content="5;URL=&quot;/q&quot;">', f'<meta name=refresh content="0; url={TO}">', '<meta http-equiv=refresh content="5">', f"<!-- a -- b --><link rel=canonical\nhref = '{TO}'\n>",
    '<link rel=canonical href="x" href="y"><link href=z rel="nofollow\tcanonical">', f'<link rel="canonical" title=\'say "hi" <link rel=canonical href="no">\' href="{TO}">', '<link rel=canonical href=" /spaces ">', '<link rel=canonical href="a&lt;b">', f"{'<p>' * 2000}<link rel=canonical href={TO}>",
]


def test_edges_as_a_parser_reads_them(spark):
    rows = [(i, f"http://own.fr/d/{i}", html) for i, html in enumerate(PAGES)]
    got: dict = {}
    for r in alias_edges(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got.setdefault(r.src, []).append(r.dst)
    for _, url, html in rows:
        t = Tags(html)
        base = urljoin(url, t.base) if t.base else url
        assert sorted(got.get(url, [])) == sorted(node(urljoin(base, x.strip())) for x in t.found), html


def test_verdicts_of_such_pages_equal_the_sql(spark, tmp_path):
    import duckdb

    rows = [(i, r.replace("own.fr", f"own{i}.fr") if i % 2 else r, html) for i, (r, html) in enumerate((f"http://own.fr/d/{n}", x) for n, x in enumerate(PAGES))]
    rows += [(100, "http://s.com/en/1", None), (101, "http://h.xx/", '<link rel=canonical href="http://t.com/en/">'), (102, "https://s.com", '<link rel=canonical href="http://t.com:80/en/">')]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = op9_url_filter(spark, str(tmp_path))
    assert difference(got, con, OP9_SQL) == ""
    verdict = {r.page_id: r.verdict for r in got.collect()}
    assert [i for i in range(12) if verdict[i] == "block"] == [3, 4, 5, 7, 8, 10]


def test_components_equal_union_find(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)]  # chains, cycles, self loops
    edges += [(1000, 1000 + i) for i in range(1, 400)] + [(2000 + i, 2001 + i) for i in range(120)] + [(3000, 3001), (3001, 3002), (3002, 3000)]
    edges += edges[:20] + [(None, 5), (7, None)]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_equals_its_sql(spark, tmp_path):
    import duckdb

    r = random.Random(2)
    hosts = ["a.com", "B.com", "www.example.com", "x.net", "example.net", "y.org"]
    paths = ["", "/", "/en/1", "/en/7/b", "/de/8?x=1", "/de/2#top", "/es/a/b.html", "/p?q=http://z.com/en/"]
    to = ["page2.html", "?id=3", "../x", "../../en/7", "./", "//B.com/en/1", "/es/./k?t=../u", "#top", "mailto:a@b.c", "HTTP://Y.org/es/q", "/en/9?a=1&amp;b=2", "en/..", ""]
    rows = []
    for i in range(300):
        url = r.choice([None, "", "no scheme"]) if i % 20 == 0 else f"{r.choice(['http', 'HTTPS'])}://{r.choice(hosts)}{r.choice(paths)}"
        target = lambda: r.choice([*to, f"http://{r.choice(hosts)}{r.choice(paths)}"])
        links = "".join(r.choice([f'<link rel="canonical" href="{target()}">', f"<LINK href='{target()}' rel=canonical>", f'<meta http-equiv="refresh" content="0; url={target()}">', "<p>"]) for _ in range(r.randrange(3)))
        rows.append((i, url, r.choice([None, "<html>" + links, links, links]) if i % 9 == 0 else "<p>", "n", "c"))
    rows += [(900 + i, "http://hub.fr/1", f'<link rel=canonical href="http://spoke.fr/{i}">', "n", "c") for i in range(60)] + [(990, "http://spoke.fr/7", "", "n", "c"), (991, "http://hub.fr/1", '<link rel=canonical href="http://q.com/en/1">', "n", "c")]
    rows += [rows[0], (None, "http://a.com/en/1", None, "n", "c")]
    spark.createDataFrame(rows, "page_id long, url string, html string, node string, component string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = op9_url_filter(spark, str(tmp_path))
    assert difference(got, con, OP9_SQL) == ""
    assert {x.verdict for x in got.where("page_id >= 900").collect()} == {"block"}


def test_empty_table(spark):
    assert judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
