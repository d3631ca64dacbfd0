import pytest
from pyspark.sql import functions as F

from strandline.operators import canonical, graph, scope, skew

URLS = [
    "https://a.example.org/x/y/1.html", "https://a.example.org/x/z", "https://a.example.org/", "https://a.example.org",
    "http://a.example.org/x/y/1.html", "https://sub.a.example.org/x/", "https://b.example.org/x/y/", "https://example.org/x/y/2#f",
    "https://a.example.org/x/y/1.html#part", "https://a.example.org/x/y?next=/q/", "https://A.example.org/x/y/", "https://aa.example.org/x/y/",
]
SEEDS = ["https://a.example.org/x/y/1.html", "https://b.example.org/x/y/start?q=1#z"]
WANT = {
    "page": {0},
    "page-spa": {0, 8},
    "prefix": {0, 6, 8},
    "host": {0, 1, 2, 3, 4, 6, 8, 9, 10},
    "domain": {0, 1, 2, 3, 4, 5, 6, 8, 9, 10},
    "any": set(range(12)),
}


@pytest.mark.parametrize("shuffled", [False, True])
@pytest.mark.parametrize("kind", list(WANT))
def test_scope_types(spark, monkeypatch, kind, shuffled):
    if shuffled:  # too many seeds for literals, tables too large to broadcast, hot keys
        monkeypatch.setattr(scope, "LITERAL_KEYS", 0)
        monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(skew, "HOT_ROWS", 2)
    urls = spark.createDataFrame(list(enumerate(URLS)), "i int, url string")
    seeds = spark.createDataFrame([(s,) for s in SEEDS], "url string")
    got = scope.in_scope(urls, seeds, kind)
    assert got.columns == ["i", "url"]
    assert sorted(r.i for r in got.collect()) == sorted(WANT[kind])


def test_scope_defaults(spark):
    urls = spark.createDataFrame(list(enumerate(URLS)), "i int, url string")
    seeds = spark.createDataFrame([(s,) for s in SEEDS], "url string")
    assert {r.i for r in scope.in_scope(urls, seeds).collect()} == WANT["prefix"]
    assert {r.i for r in scope.in_scope(urls, seeds, include=r"\.html").collect()} == {0, 4, 8}
    with pytest.raises(ValueError):
        scope.in_scope(urls, seeds, "planet")


def test_flag_scope_and_reach(spark):
    links = spark.createDataFrame(
        [("http://a/x", "http://a/y"), ("http://a/y", "http://b/1"), ("http://b/1", "http://b/2"), ("http://b/2", "http://b/3"), ("http://b/1", "http://a/z")],
        "src string, dst string",
    )
    seeds = spark.createDataFrame([("http://a/x",)], "url string")
    flagged = scope.flag_scope(links, seeds, "host")
    got = {tuple(r) for r in graph.reach(seeds, flagged, extra_hops=2).collect()}
    assert got == {("http://a/x", 0, 0), ("http://a/y", 1, 0), ("http://b/1", 2, 1), ("http://b/2", 3, 2), ("http://a/z", 3, 1)}


def test_rules(spark):
    df = spark.createDataFrame(
        [("http://h/a", "good text"), ("http://h/ads/1", "x"), ("http://h/frame", "BUY now"), ("http://h/frame", "news"), ("http://h/frame", None)],
        "url string, text string",
    )
    rules = [scope.BlockRule("/ads/"), scope.BlockRule("frame", "BUY")]
    assert [r.text for r in scope.block(df, rules).collect()] == ["good text", "news", None]
    replaced = scope.block(df, rules, "gone").collect()
    assert [(r.text, r.blocked) for r in replaced] == [("good text", False), ("gone", True), ("gone", True), ("news", False), (None, False)]
    assert scope.exclude_rx(df, [r"\?q=", "ads", "/a$"]).count() == 3


@pytest.mark.parametrize("shuffled", [False, True])
def test_block_hosts(spark, monkeypatch, tmp_path, shuffled):
    if shuffled:
        monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(skew, "HOT_ROWS", 2)
    path = tmp_path / "hosts.txt"
    path.write_text("# list\n127.0.0.1 Ads.example.org\n0.0.0.0 track.example.org # note\n\nminer.example.org\n")
    hosts = scope.hosts_of(spark.read.text(str(path)))
    assert {r.host for r in hosts.collect()} == {"ads.example.org", "track.example.org", "miner.example.org"}
    df = spark.createDataFrame(
        [(i, u) for i, u in enumerate(["http://ads.example.org/1", "http://ADS.example.org:81/2", "http://x.ads.example.org/", "http://ok.org/"])],
        "capture_id int, url string",
    )
    assert sorted(r.capture_id for r in scope.block_hosts(df, hosts).collect()) == [2, 3]
    marked = scope.block_hosts(df, hosts, "no ads").collect()
    assert sorted((r.capture_id, r.blocked) for r in marked) == [(0, True), (1, True), (2, False), (3, False)]


def test_sitemap_dates(spark):
    df = spark.createDataFrame([("2021",), ("2021-06",), ("2021-06-15",), ("2021-06-15T10:00:00",), (None,), ("soon",)], "lastmod string")

    def kept(*bounds):
        return [r.lastmod for r in scope.sitemap_between(df, *bounds).collect()]

    assert kept("2021-06", None) == ["2021-06", "2021-06-15", "2021-06-15T10:00:00", None, "soon"]
    assert kept(None, "2021-06-15") == ["2021", "2021-06", "2021-06-15", None, "soon"]
    typed = df.select(F.try_to_timestamp("lastmod").alias("lastmod"))
    assert scope.sitemap_between(typed, "2021-06-15", "2021-06-15").count() == 3


@pytest.fixture
def captures(spark):
    return spark.range(100).select(
        F.col("id").alias("capture_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.lit(10).cast("bigint").alias("bytes"), (F.col("id") % 2).alias("site")
    )


def test_page_limit(captures):
    def ids(df):
        return sorted(r.capture_id for r in df.collect())

    assert ids(scope.page_limit(captures)) == list(range(100))
    for top_k in (scope.TOP_K, 0):
        assert ids(scope.page_limit(captures, 7, top_k=top_k)) == list(range(7))
        assert ids(scope.page_limit(captures, 7, 3, top_k=top_k)) == [0, 1, 2]
        assert ids(scope.page_limit(captures, 3, per=["site"], top_k=top_k)) == list(range(6))


def test_limit_cut(captures):
    soft = scope.limit_cut(captures, 95)  # the tenth record crosses
    assert soft.partial and soft.df.count() == 10
    assert scope.limit_cut(captures, 100).df.count() == 11  # 100 bytes do not exceed 100
    hard = scope.limit_cut(captures, 95, mode="hard")
    assert hard.partial and hard.df.count() == 0
    whole = scope.limit_cut(captures, 1000, mode="hard")
    assert not whole.partial and whole.df.count() == 100
    timed = scope.limit_cut(captures, 120, by="elapsed")
    assert timed.partial and timed.df.count() == 3
    assert not scope.limit_cut(captures, 99 * 60, by="elapsed").partial


def test_exclusive_limits():
    assert scope.exclusive(5, None) == (5, "soft") and scope.exclusive(None, 6) == (6, "hard") and scope.exclusive(None, None) is None
    with pytest.raises(ValueError):
        scope.exclusive(1, 2)


def test_collisions_and_origin(spark):
    df = spark.createDataFrame(
        [("https://h.org:443/a",), ("https://h.org/a",), ("http://h.org/a#x",), ("http://h.org/a#x",), ("http://h.org:bad/",)], "url string"
    )
    rows = {r.entry: tuple(r)[1:] for r in canonical.collisions(df).collect()}
    assert rows == {"h.org/a": (3, 4, 2), None: (1, 1, 1)}
    mapping = spark.createDataFrame([("https://H.org:443", "http://alt:81")], "origin string, replacement string")
    moved = [r.url for r in canonical.override_origin(df, mapping).collect()]
    assert sorted(moved) == sorted(["http://alt:81/a", "https://h.org/a", "http://h.org/a#x", "http://h.org/a#x", "http://h.org:bad/"])
