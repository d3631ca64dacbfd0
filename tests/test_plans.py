import pytest
from pyspark.sql import functions as F

from strandline.operators.scope import BlockRule
from strandline.plans.archive_build import Recipe, build_archive, select_captures
from strandline.plans.archive_report import host_report


@pytest.fixture
def crawl(spark):
    rows = [
        (1, 0, "https://site.org/a", 200, 40, "x", "text"), (2, 10, "https://site.org/a#top", 200, 40, "x", "text"),
        (3, 20, "https://site.org/b?utm_x=1", 200, 40, "y", "text"), (4, 30, "https://ads.site.net/", 200, 40, "z", "text"),
        (5, 40, "https://site.org/c", 404, 40, "w", "BUY"), (6, 50, "https://other.org/", 200, 40, "v", "text"), (7, 60, "https://site.org/d", 0, 40, "u", "text"),
    ]
    df = spark.createDataFrame(rows, "capture_id bigint, t bigint, url string, status int, bytes bigint, digest string, text string")
    seeds = spark.createDataFrame([(0, "https://site.org/")], "pos int, url string")
    return df.select("*", F.timestamp_seconds("t").alias("ts")).drop("t"), seeds


def test_select(spark, crawl):
    hosts = spark.createDataFrame([("ads.site.net",)], "host string")

    def ids(**options):
        return sorted(r.capture_id for r in select_captures(*crawl, Recipe("x", **options), hosts).collect())

    assert ids() == [1, 3, 5, 7]
    assert ids(scope_type="any", exclude=["utm_"]) == [1, 5, 6, 7]
    assert ids(allow_hash=True) == [1, 2, 3, 5, 7]
    assert ids(dedup_policy="keep") == [1, 2, 3, 5, 7]
    assert ids(block_rules=[BlockRule("/c$", "BUY")]) == [1, 3, 7]
    assert ids(page_limit=9, max_page_limit=2) == [1, 3]
    assert ids(scope_type="any", ad_message="was an ad") == [1, 3, 4, 5, 6, 7]


def test_overwrite(spark, crawl, tmp_path):
    out = str(tmp_path / "out")
    first = build_archive(*crawl, Recipe(out, buckets=2))
    assert (first.exit_code, first.outcome, first.partial) == (0, "complete", False)
    assert first.stats == {"crawled": 3, "pending": 0, "failed": 1, "total": 4, "limit": {"max": 0, "hit": False}}
    for _ in range(2):
        assert build_archive(*crawl, Recipe(out, buckets=2)).exit_code == 2
    assert build_archive(*crawl, Recipe(out, buckets=2, overwrite=True, page_limit=1)).exit_code == 0
    assert spark.read.parquet(out).count() == 1


@pytest.mark.parametrize(
    "options,code,outcome,rows",
    [
        ({"size_soft_limit": 60}, 0, "partial", 2), ({"size_hard_limit": 60}, 14, "failed", None), ({"size_hard_limit": 900}, 0, "complete", 4),
        ({"time_soft_limit": 30}, 0, "partial", 2), ({"time_hard_limit": 30}, 15, "failed", None), ({"fail_on_failed_limit": 1}, 0, "complete", 4),
        ({"fail_on_failed_limit": 1, "invalid_status_fails": True}, 1, "failed", None),
    ],
)
def test_limits(spark, crawl, tmp_path, options, code, outcome, rows):
    out = str(tmp_path / "out")
    built = build_archive(*crawl, Recipe(out, buckets=2, **options))
    assert (built.exit_code, built.outcome, built.partial) == (code, outcome, outcome == "partial")
    assert (tmp_path / "out").exists() == (rows is not None)
    if rows:
        assert spark.read.parquet(out).count() == rows


def test_failed_seed_and_conflicting_limits(spark, crawl, tmp_path):
    captures, _ = crawl
    seeds = spark.createDataFrame([(0, "https://site.org/d"), (1, "https://site.org/a")], "pos int, url string")
    recipe = Recipe(str(tmp_path / "out"), fail_on_failed_seed=True)
    assert build_archive(captures, seeds, recipe).exit_code == 1
    with pytest.raises(ValueError):
        build_archive(captures, seeds, Recipe("x", size_soft_limit=1, size_hard_limit=2))


def test_host_report(spark, crawl):
    captures, _ = crawl
    hosts = spark.createDataFrame([("ads.site.net",)], "host string")
    with_host = captures.withColumn("host", F.regexp_extract("url", "//([^/]+)", 1))
    got = {r.host: tuple(r)[1:] for r in host_report(with_host, hosts, ["utm_"]).collect()}
    assert got == {"site.org": (3, 1, 2, 3, 120), "other.org": (1, 1, 0, 1, 40)}


def test_whole_run(spark, crawl, tmp_path, monkeypatch):
    """Depth over links, sitemap dates, retries, another origin, index, metadata,
    progress; no body in any intermediate table."""
    from strandline.plans import archive_build

    stored = []
    for module in (archive_build, archive_build.lookup_join.__globals__):
        keep = module["written"] if isinstance(module, dict) else module.written
        spy = lambda df, label, keep=keep: stored.append(df.columns) or keep(df, label)
        monkeypatch.setitem(module, "written", spy) if isinstance(module, dict) else monkeypatch.setattr(module, "written", spy)
    captures, start = crawl
    captures = captures.withColumns({"attempt": F.lit(1), "html": F.concat(F.lit("<html lang=fr><title>"), "url", F.lit("</title>"))})
    again = captures.filter("capture_id = 7").withColumns({"capture_id": F.lit(8).cast("bigint"), "attempt": F.lit(2), "status": F.lit(200), "digest": F.lit("new")})
    links = [("https://site.org/", "https://site.org/a"), ("https://site.org/a", "https://site.org/d"), ("https://site.org/d", "https://site.org/c")]
    links = spark.createDataFrame(links, "src string, dst string")
    sitemap = spark.createDataFrame([("https://other.org/", "2024-05-01"), ("https://ads.site.net/", "2019")], "loc string, lastmod string")
    recipe = Recipe(str(tmp_path / "out"), buckets=2, depth=2, sitemap_from="2020", max_retries=1)
    built = build_archive(captures.unionByName(again), start, recipe, links=links, sitemap=sitemap)
    kept = {r.capture_id: r.url for r in spark.read.parquet(recipe.output).collect()}
    assert sorted(kept) == [1, 6, 8]
    assert (built.exit_code, built.outcome, tuple(built.progress.first())) == (0, "complete", (3, 3, False))
    assert [r.key for r in spark.read.parquet(recipe.output + "-index").orderBy("key").collect()] == ["org,other)/", "org,site)/a", "org,site)/d"]
    assert {(r.site, r["Language"]) for r in built.metadata.collect()} == {("site.org", "eng"), ("other.org", "fra")}
    assert stored and not [c for c in stored if {"html", "text", "body"} & set(c)]

    mapping = spark.createDataFrame([("https://other.org", "https://site.org")], "origin string, replacement string")
    moved = build_archive(captures, start, Recipe(str(tmp_path / "moved"), buckets=2, exclude=["utm_"]), mapping=mapping)
    assert moved.stats["total"] == 4 and spark.read.parquet(str(tmp_path / "moved")).filter("url = 'https://site.org/'").count() == 1
