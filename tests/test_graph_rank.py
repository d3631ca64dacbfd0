import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import graph, rank, skew


def walk(seeds, links, depth, extra_hops):
    """States no other state beats, by brute force over (node, depth, extra)."""
    states = {(s, 0, 0) for s in seeds}
    frontier, level = set(states), 0
    while frontier and level != depth:
        level += 1
        found = {(d, level, e + (not ok)) for n, _, e in frontier for s, d, ok in links if s == n and e + (not ok) <= extra_hops}
        frontier = {f for f in found if not any(n == f[0] and e <= f[2] for n, _, e in states)}
        states |= frontier
    return {a for a in states if not any(b != a and b[0] == a[0] and b[1] <= a[1] and b[2] <= a[2] for b in states)}


@pytest.mark.parametrize("depth,extra,hot", [(-1, 0, True), (2, 0, False), (0, 0, False), (-1, 2, True), (4, 1, False)])
def test_reach(spark, monkeypatch, depth, extra, hot):
    if hot:
        monkeypatch.setattr(skew, "HOT_ROWS", 5)
        monkeypatch.setattr(graph, "ROWS_PER_BUCKET", 40)
    rng = random.Random(7)
    # node 0 is the source of a third of all links
    links = list({(0 if i % 3 == 0 else rng.randrange(60), rng.randrange(60)) for i in range(150)})
    links = [(s, d, d % 4 != 1) for s, d in links]
    df = spark.createDataFrame(links, "src bigint, dst bigint, in_scope boolean")
    seeds = spark.createDataFrame([(0,), (1,), (0,), (None,)], "url bigint")
    got = {tuple(r) for r in graph.reach(seeds, df, depth, extra).collect()}
    assert got == walk({0, 1}, links, depth, extra)


def test_reach_grows_with_depth(spark):
    links = spark.range(6).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    seeds = spark.createDataFrame([(0,)], "url bigint")
    sizes = [graph.reach(seeds, links, d).count() for d in (1, 3, -1)]
    assert sizes == [2, 4, 7]


@pytest.mark.parametrize("hot", [False, True])
def test_redirects(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(skew, "HOT_ROWS", 5)
    pairs = {i: i + 1 for i in range(100)}  # a chain that ends outside the table
    pairs |= {1000: 1000}  # leads to itself: an end
    pairs |= {2000 + i: 1000 for i in range(80)}  # many to one
    for start, size in ((3000, 2), (3100, 3), (3200, 4), (3300, 8)):  # loops
        pairs |= {start + i: start + (i + 1) % size for i in range(size)}
    pairs |= {3400: 3000, 3401: 3400}  # into a loop
    want = {}
    for s in pairs:
        at, seen = s, [s]
        while at in pairs and pairs[at] != at and pairs[at] not in seen:
            at = pairs[at]
            seen.append(at)
        looping = at in pairs and pairs[at] != at
        want[s] = (None, None, True) if looping else (at, len(seen) - 1, False)
    got = graph.resolve_redirects(spark.createDataFrame(list(pairs.items()), "src bigint, dst bigint")).collect()
    assert {r.src: (r.target, r.hops, r.loop) for r in got} == want


def test_redirect_map_and_homepage(spark):
    rows = [
        (1, "http://h/a", 301, "/b"), (2, "http://h/a", 302, "https://h:443/c"), (3, "https://h/c", 308, "d?x"),
        (4, "http://h/e", 200, "/f"), (5, "http://h/g", 307, None), (6, "http://h/i", 303, "/j"),
    ]
    df = spark.createDataFrame(rows, "t bigint, url string, status int, redirect_to string").withColumn("ts", F.timestamp_seconds("t"))
    hops = graph.redirect_map(df)
    assert {tuple(r) for r in hops.collect()} == {("http://h/a", "https://h/c"), ("https://h/c", "https://h/d?x")}
    seeds = spark.createDataFrame([(1, "http://h/z"), (0, "http://h/a")], "pos int, url string")
    assert tuple(rank.homepage(seeds, hops).first()) == ("http://h/a", "https://h/d?x")
    assert tuple(rank.homepage(seeds.filter("pos = 1"), hops).first()) == ("http://h/z", "http://h/z")


def test_extract_links(spark):
    html = """<A HREF='/one'>1</A> <a class=x href=two.html>2</a> <a name="n">no</a> <!-- <a href="/hidden"> -->
    <script>document.write('<a href="/js">')</script> <a href="?q=1&amp;r=2">q</a> <a href="#top">t</a> <a href="mailto:a@b.c">m</a>
    <a href="HTTP://Other.org:80/x#frag">o</a> <a href=" ../up ">u</a> <a href="/one">again</a> <a data-href="/no" title="t">d</a>
    <img src="/pic.png"><a href="//cdn.org/z">c</a><a href="http://h:99999/">bad</a>"""
    pages = spark.createDataFrame([("https://h.org/d/e/page.html?z=1", html)], "url string, html string")

    def found(*rules, **options):
        return {r.dst for r in graph.extract_links(pages, rules or ("a[href]->href",), **options).collect()}

    want = {
        "https://h.org/one", "https://h.org/d/e/two.html", "https://h.org/d/e/page.html?q=1&r=2", "https://h.org/d/e/page.html?z=1",
        "http://Other.org/x", "https://h.org/d/up", "https://cdn.org/z",
    }
    assert found() == want
    assert found(dedupe=False) == want
    assert found("a->@href", "img->@src") == want | {"https://h.org/pic.png"}
    assert "http://Other.org/x#frag" in found(allow_hash=True)
    with pytest.raises(ValueError):
        found("div > a:hover->href")


def test_frontier(spark):
    known = spark.createDataFrame([("http://h:80/a",), ("http://h/b",), ("http://h/b",), ("http://h:x/",)], "url string")
    seen = spark.createDataFrame([("http://h/a",)], "url string")
    assert [r.url for r in graph.frontier(known, seen).collect()] == ["http://h/b"]


CAPTURES = [
    (1, 10, "http://h/a", "x"), (2, 11, "http://h:80/a", "x"), (3, 9, "http://h/a", "y"), (4, 12, "http://h/b", "x"),
    (5, 10, "http://h/a", "x"), (6, 13, "http://h:bad/", "x"), (7, 14, "http://h:bad2/", "x"),
    (8, 15, "http://h/n", None), (9, 16, "http://h/n", None),
]


@pytest.mark.parametrize("hot", [False, True])
def test_dedup(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(skew, "HOT_ROWS", 2)
    df = spark.createDataFrame(CAPTURES, "capture_id bigint, t bigint, url string, digest string").withColumn("ts", F.timestamp_seconds("t"))

    def ids(d):
        return sorted(r.capture_id for r in d.collect())

    skip = rank.dedup(df)
    assert ids(skip) == [1, 3, 4, 6, 7, 8, 9]
    assert ids(rank.dedup(skip)) == [1, 3, 4, 6, 7, 8, 9]
    assert ids(rank.dedup(df, key=("digest",))) == [1, 3, 8, 9]
    assert ids(rank.dedup(df, "keep")) == [1, 2, 3, 4, 5, 6, 7, 8, 9]
    again = {r.capture_id: r.revisit_of for r in rank.dedup(df, "revisit").collect()}
    assert again == {1: None, 2: 1, 3: None, 4: None, 5: 1, 6: None, 7: None, 8: None, 9: None}
    with pytest.raises(ValueError):
        rank.dedup(df, "maybe")


def test_final_attempt(spark):
    rows = [
        (1, "a", 1, True), (2, "a", 2, True), (3, "a", 3, True), (4, "a", 4, False),  # success comes too late
        (5, "b", 1, True), (6, "b", 2, False), (7, "b", 3, False), (8, "c", 1, True), (9, "c", 2, True),
    ]
    df = spark.createDataFrame(rows, "capture_id bigint, url string, attempt bigint, failed boolean")
    got = {r.url: (r.capture_id, r.failed, r.attempts_used) for r in rank.final_attempt(df).collect()}
    assert got == {"a": (3, True, 3), "b": (6, False, 2), "c": (9, True, 2)}
    assert {r.url: r.failed for r in rank.final_attempt(df, 3).collect()}["a"] is False


def test_retain_latest(spark):
    df = spark.range(30).select((F.col("id") % 3).alias("crawl_id"), F.col("id").alias("state_id"), F.timestamp_seconds(F.col("id") * 0 + 5).alias("ts"))
    kept = {r.state_id for r in rank.retain_latest(df, 2).collect()}
    assert kept == {24, 25, 26, 27, 28, 29}
    assert rank.retain_latest(df).count() == 15


def test_one_chain(spark):
    hops = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "c"), ("x", "y"), ("y", "x"), ("z", "a")], "src string, dst string")
    assert [graph.chain_end(hops, u) for u in ("z", "c", "q", "x")] == ["c", "c", "q", None]


def test_finished_redirects_are_written_once(spark, monkeypatch):
    """Chains of one hop but for one long chain: the short ones are stored in the first round only."""
    sizes = []
    keep = graph.written
    monkeypatch.setattr(graph, "written", lambda df, label: sizes.append((t := keep(df, label)).count()) or t)
    hops = [(f"s{i}", f"t{i}") for i in range(500)] + [(f"c{i}", f"c{i + 1}") for i in range(40)]
    found = {r.src: (r.target, r.hops) for r in graph.resolve_redirects(spark.createDataFrame(hops, "src string, dst string")).collect()}
    assert found["s7"] == ("t7", 1) and found["c0"] == ("c40", 40) and len(found) == 540
    assert sizes[:2] == [540, 540] and sum(sizes[2:]) < 300
