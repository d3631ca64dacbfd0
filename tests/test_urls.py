import random
from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from strandline.functions import urls as U
from strandline.session import written

CASES = [
    "https://example.com:443/", "http://example.com:80", "https://example.com:80/", "http://example.com:443/x",
    "HTTPS://Example.com/Path?", "http://h/a?#f", "http://h/a#", "http://h/a?b=1#", "http://h:0080/a?x", "http://h:/a",
    "http://user:pw@h:80/a", "https://[::1]:443/x", "http://h:80?q", "ftp://h:80/", "http://h/a;", "http://h/a;b?c",
    "http://h/a??", "", "www.example.com/a", "http://h/x y", " \thttp://h/a\n", "http://h:8080/", "http://h/a:80/",
    "https://h/?u=http://x:80/", "http://h:65535/", "https://h:443#frag", "http://user:pw@h/a",
]
BAD = ["http://h:99999/", "https://h:abc/", "http://[::1/", "http://a:b:80/", "http://h:65536"]


def one_column(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "url string")


def expected(url):
    p = urlparse(url)
    if p.scheme in ("http", "https") and p.port == {"http": 80, "https": 443}[p.scheme]:
        p = p._replace(netloc=p.netloc[: p.netloc.rindex(":")])
    return p.geturl()


def test_clean_url_agrees_with_standard_library(spark):
    rows = one_column(spark, CASES).select("url", U.clean_url("url").alias("c")).collect()
    assert {r.url: r.c for r in rows} == {u: expected(u) for u in CASES}


def test_clean_url_agrees_on_random_urls(spark):
    rng = random.Random(5)
    parts = [
        ["http", "https", "HTTP", "Https", "ftp"], ["://"], ["", "u@", "u:p@", "u:80@"], ["h", "Ex.org", "[::1]", "1.2.3.4"],
        ["", "", ":", ":80", ":443", ":0080", ":00443", ":8080", ":65535", ":65536", ":99999", ":x", ":80x", ":-1"],
        ["", "/", "/a", "/a;", "/a;b", "/;", "/a;/b", "/a:80/"], ["", "?", "?q", "??", "?u=http://x:80/", "?a;"], ["", "#", "#f", "##", "#:443/"],
    ]
    urls = sorted({"".join(rng.choice(p) for p in parts) for _ in range(6000)})

    def want(url):
        try:
            return expected(url)
        except ValueError:
            return None

    rows = one_column(spark, urls).select("url", U.clean_url("url").alias("c")).collect()
    assert [(r.url, r.c, want(r.url)) for r in rows if r.c != want(r.url)] == []


def test_clean_url_is_idempotent(spark):
    once = written(one_column(spark, CASES).select(U.clean_url("url").alias("a")), "once")
    assert once.filter(~U.clean_url("a").eqNullSafe(F.col("a"))).count() == 0


def test_bad_ports_give_null(spark):
    for url in BAD:
        with pytest.raises(ValueError):
            expected(url)
    assert one_column(spark, BAD).filter(U.clean_url("url").isNotNull()).count() == 0


def test_resolve_agrees_with_standard_library(spark):
    bases = ["http://h/a/b.html?x=1#t", "https://h.example.com", "http://h/", "http://h:81/a/b/c/"]
    hrefs = ["c", "/c", "../c", "./c", "../../c?d#e", "?q=1", "#f", "//o/x", "http://o/y", "c/../d", "/a/./b/../c", "..", "."]
    df = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string")
    got = {(r.b, r.h): r.u for r in df.select("b", "h", U.resolve("b", "h").alias("u")).collect()}
    assert got == {(b, h): urljoin(b, h) for b in bases for h in hrefs}


def test_entry_path_and_parts(spark):
    rows = {
        "https://www.example.com": "www.example.com/",
        "http://www.example.com/": "www.example.com/",
        "https://u:p@h.org:8443/a/b?c=d#e": "h.org/a/b?c=d",
        "http://h.org?x=1": "h.org/?x=1",
    }
    got = one_column(spark, list(rows)).select("url", U.entry_path("url").alias("p")).collect()
    assert {r.url: r.p for r in got} == rows
    parts = one_column(spark, ["HTTP://A.B.org:80/x/y.html?z/#q"]).select(
        U.host("url").alias("h"), U.origin("url").alias("o"), U.directory("url").alias("d"), U.sort_key("url").alias("k")
    ).first()
    assert tuple(parts) == ("a.b.org", "http://a.b.org:80", "HTTP://A.B.org:80/x/", "org,b,a)/x/y.html?z/")


def test_strip_fragment(spark):
    row = one_column(spark, ["http://h/a#b#c"]).select(U.strip_fragment("url").alias("a"), U.strip_fragment("url", True).alias("b")).first()
    assert tuple(row) == ("http://h/a", "http://h/a#b#c")
