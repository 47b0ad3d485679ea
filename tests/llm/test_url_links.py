"""Links that pages declare, in the forms that HTML allows; the query against a brute-force version."""

import random
from html.parser import HTMLParser
from urllib.parse import urljoin

from tests.compare import plain, rows
from turnlake.llm import url_equivalence as U

PAGE = "http://h.net/a/b/page.html?q=1"
TARGETS = [
    ('<link rel="canonical" href="page2.html">', "http://h.net/a/b/page2.html"),
    ("<link href='../x' rel=canonical>", "http://h.net/a/x"),
    ("<link rel=canonical href=?id=1>", "http://h.net/a/b/page.html?id=1"),
    ('<link rel="shortlink canonical" href="/p?a=1&amp;b=2&#38;c=3&#x2f;4">', "http://h.net/p?a=1&b=2&c=3/4"),
    ('<link rel="canonical" href="./../../../k/./m/..">', "http://h.net/k/"),
    ('<link rel="canonical" href="/out?u=http://other.net/">', "http://h.net/out?u=http://other.net/"),
    ('<link rel="canonical" href="/&#9999999;&#xd800;&#228;&amp;lt;">', "http://h.net/&"),  # what follows the first # is a fragment
    ('<link rel="canonical" href="/&#228;&amp;lt;">', "http://h.net/ä&lt;"),
    ("<meta http-equiv=refresh content=0;url=//c.net/z>", "http://c.net/z"),
    ("""<META content="5; URL='next.html'" HTTP-EQUIV="Refresh">""", "http://h.net/a/b/next.html"),
    ('<base href="http://base.net/d/"><link rel="canonical" href="e">', "http://base.net/d/e"),
    ('<link rel="stylesheet" href="s.css"><link rel="canonical" data-href="no" href="https://c.net/1">', "https://c.net/1"),
    ('<!-- <link rel="canonical" href="/no"> --><link rel=canonical href="HTTP://C.net/A?B#top"><!-- <link rel=canonical href=/never>', "http://c.net/A?B"),
    ('<link rel="canonical" href="#top"><link rel="canonical" href="mailto:x@y"><link rel="next" href="n">', None),
]


def links(spark, html):
    return sorted(r.target for r in U.alias_links(spark.createDataFrame([(1, PAGE, html)], "page_id long, url string, html string")).collect())


def test_every_form_of_target(spark):
    pages = spark.createDataFrame([(i, PAGE + "&n=%d" % i, html) for i, (html, _) in enumerate(TARGETS)], "page_id long, url string, html string")
    got = {int(r.url.split("n=")[1]): r.target for r in U.alias_links(pages).collect()}
    assert got == {i: t for i, (_, t) in enumerate(TARGETS) if t}


def test_all_links_of_a_page(spark):
    html = "".join(h for h, _ in TARGETS if "<base" not in h)
    assert links(spark, html) == sorted({t for h, t in TARGETS if t and "<base" not in h})


def test_a_block_reaches_a_relative_alias(spark):
    rows = [(1, "http://h.net/bad/x.html", "<link rel=canonical href=../free/y>"), (2, "http://h.net/free/y", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, r.via_alias) for r in U.judge_urls(pages, U.alias_links(pages), [("block", "h.net", "/bad/")]).collect()}
    assert got == {1: ("block", False), 2: ("block", True)}


def test_fragments_and_letters_of_hosts_do_not_part_aliases(spark):
    link = lambda url: f'<link rel="canonical" href="{url}">'
    rows_ = [(1, "http://a.net/1", link("http://b.net/2#top")), (2, "http://c.net/1", link("HTTP://B.net/2")), (3, "http://d.net/1", link("http://b.net/2")), (4, "http://b.net/2", link("http://x.com/de/1")), (5, "http://e.net/", "<!--" + link("http://x.com/de/1") + "-->"), (6, "http://D.NET/1#z", "")]
    pages = spark.createDataFrame(rows_, "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in U.judge_urls(pages, U.alias_links(pages)).collect()} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "block"}


def against_sql(spark, folder):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    df = U.op5_url_equivalence(spark, str(folder))
    answer = con.execute(U.ORACLE_SQL["op5_url_equivalence"])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in answer.description], answer.fetchall()) and plain(1) == 1


def test_every_form_of_link_against_sql(spark, tmp_path):
    forms = [(i, f"http://h{i}.net/a/b/page.html?q=1", html) for i, (html, _) in enumerate(TARGETS)]
    forms += [(100 + i, t if "h.net" not in t else t.replace("h.net", f"h{i}.net"), "<link rel=canonical href=http://x.com/de/2>") for i, (_, t) in enumerate(TARGETS) if t]
    spark.createDataFrame(forms, "page_id long, url string, html string").repartition(2).write.parquet(str(tmp_path / "pages.parquet"))
    against_sql(spark, tmp_path)
    blocked = U.op5_url_equivalence(spark, str(tmp_path)).filter("via_alias").count()
    assert blocked >= 2 * sum(t is not None for _, t in TARGETS) - 4


class Declared(HTMLParser):
    def __init__(self):
        super().__init__()
        self.targets = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "link" and "canonical" in a.get("rel", "").lower().split():
            self.targets.append(a.get("href", ""))
        if tag == "meta" and a.get("http-equiv", "").lower() == "refresh" and "url=" in a.get("content", "").lower():
            self.targets.append(a["content"][a["content"].lower().index("url=") + 4 :].strip(" '\""))


def verdicts(rows):
    """host, path, rule and verdict of each row, by the words of the contract, with union-find over links."""
    def parts(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        path = rest[cut:]
        return rest[:cut].translate({c: c + 32 for c in range(65, 91)}), path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]

    def rule(url):
        host, path = parts(url)
        fits = [(len(h + p), v, h + p) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits, default=None)

    parent = {}

    def key(url):
        head, mark, rest = url.partition("://")
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        return (head + mark + rest[:cut]).lower() + rest[cut:].split("#")[0] if mark else url

    def root(x):
        x = key(x)
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for _, url, html in rows:
        found = Declared()
        found.feed(html or "")
        for target in found.targets:
            if url and target.strip():
                parent[root(url)] = root(urljoin(url, target.strip()))
    blocked = {root(u) for u in list(parent) if (rule(u) or (0, ""))[1] == "block"}
    out = []
    for page, url, _ in rows:
        own = rule(url)
        out.append((str(page), *parts(url), own[2] if own else None, own[1] if own else "block" if url and key(url) in parent and root(url) in blocked else "allow"))
    return sorted(out, key=str)


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    hosts = ["a.net", "B.net", "x.com", "sub.example.org", "y.com"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(('de', 'fr', 'es', 'k'))}/{n}" for n in range(120)] + [f"http://n{n}.net/p" for n in range(80)]
    forms = ["<link rel=canonical href='{}'>", '<LINK href="{}" rel="next canonical">', '<meta content="3;URL={}" http-equiv=Refresh>', "<link rel=stylesheet href='{}'>"]
    link = lambda url: rng.choice(forms).format(url if rng.random() < 0.6 else rng.choice((f"../k/{rng.randrange(120)}", f"/de/{rng.randrange(120)}", f"//n{rng.randrange(80)}.net/p", "?x=1")))
    rows = [(n, url, "<html>" + "".join(link(rng.choice(urls)) for _ in range(rng.choice((0, 0, 1, 1, 2))))) for n, url in enumerate(urls)]
    rows += [(500, None, link(urls[0])), (None, urls[3], None), (501, "no scheme", ""), (7, urls[7], ""), (502, "http://n0.net/p", "x" * 200_000 + link(urls[1]))]
    spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, verdict string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in U.op5_url_equivalence(spark, str(tmp_path)).collect()), key=str)
    want = verdicts(rows)
    assert got == want and sum(r[4] == "block" and r[3] is None for r in want) > 10
    against_sql(spark, tmp_path)
