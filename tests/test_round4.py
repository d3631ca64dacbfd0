"""Faults found in the third round: each test failed before its change."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from strandline.operators import scope
from strandline.plans.queries import QUERIES
from strandline.sources import sinks, warc

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@contextmanager
def setting(spark, key, value):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@pytest.mark.parametrize("enabled", ["false", "true"])
def test_warc_files_are_read_with_and_without_pushed_filters(spark, tmp_path, enabled):
    rows = [("response", "http://a/1", 200), ("request", "http://a/2", None), ("response", "http://b/3", 404), ("response", None, 200)]
    with setting(spark, PUSHDOWN, enabled):
        warc.register(spark)
        spark.createDataFrame(rows, "rec_type string, url string, status int").write.format("warc").mode("append").save(str(tmp_path / "w"))
        found = spark.read.format("warc").load(str(tmp_path / "w")).filter("rec_type <> 'warcinfo'")
        assert sorted(found.select("rec_type", "url", "status").collect(), key=repr) == sorted(rows, key=repr)
        some = found.filter("rec_type = 'response' and url like 'http://a%' and status > 100")
        assert [tuple(r) for r in some.select("url", "status").collect()] == [("http://a/1", 200)]
    warc.register(spark)


def test_registered_warc_queries_in_a_session_without_pushdown(spark, tmp_path):
    pages = [(i, f"https://h{i % 3}.org/{i}", f"<p>{i}</p>") for i in range(9)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    events = spark.range(30).select(
        F.col("id").alias("event_id"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"), (F.col("id") % 5).alias("user_id"),
        F.element_at(F.array(*map(F.lit, ("view", "click", "error"))), (F.col("id") % 3 + 1).cast("int")).alias("event_type"),
        (F.col("id") / 2).alias("value"),
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    with setting(spark, PUSHDOWN, "false"):
        assert sorted(r.url for r in QUERIES["S2_warc_scan"](spark, str(tmp_path)).collect()) == sorted(u for _, u, _ in pages)
        assert QUERIES["S2_warc_to_dedup"](spark, str(tmp_path)).count() == 9
        assert {r.host for r in QUERIES["S2_warc_to_ua_audit"](spark, str(tmp_path)).collect()} <= {"h0.org", "h1.org", "h2.org"}
    warc.register(spark)


def test_sitemap_seeds_hold_undated_pages(spark, tmp_path):
    pages = [(i, f"https://h{i % 2}.org/{lang}/{i}", "") for i, lang in enumerate(("es", "de", "en", "en", "fr", "en", "en", "fr"))]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = QUERIES["S4_sitemap_seeds"](spark, str(tmp_path)).collect()
    assert sorted(r.url for r in found) == sorted(u for _, u, _ in pages)


def test_rules_are_tested_with_few_urls(spark):
    n = 600
    urls = spark.range(100, 100 + n).select(F.concat(F.lit("http://www.h.org/en/"), "id", F.lit("/")).alias("url"))
    pattern = F.concat(F.lit("^https?://(?:www|blog)[.].*/"), F.col("id"), F.lit("[^0-9]"))
    deep = F.concat(F.lit("/en/"), F.col("id"), F.lit("([/?.#]|$)"))
    rules = spark.range(100, 100 + n).select(F.explode(F.array(pattern, deep)).alias("pattern"), F.lit(None).cast("string").alias("text"))
    tested = scope.tested_rules(urls, rules)
    assert tested.count() <= 12 * n
    assert scope.matching_rules(urls, rules).filter("always").count() == n


def test_nearest_tells_urls_of_one_key_apart(spark, tmp_path):
    """The key has neither scheme nor fragment, so captures of other URLs were found."""
    rows = [(1, 100, "https://a.org/p"), (2, 150, "https://a.org/p#top"), (3, 160, "http://a.org/p"), (4, 900, "https://a.org/p"), (5, 8_000, "https://a.org/p#end"), (6, 155, None)]
    captures = spark.createDataFrame(rows, "capture_id bigint, s bigint, url string").select("capture_id", F.timestamp_seconds("s").alias("ts"), "url")
    sinks.write_index(captures, str(tmp_path / "index"))
    asked = [(i, 155, u) for i, u in enumerate(("https://a.org/p", "https://a.org/p#top", "http://a.org/p", "https://a.org/p#end", "https://a.org/p#none", None))]
    asked.append((6, 900, "https://a.org/p#top"))
    queries = spark.createDataFrame(asked, "n int, s bigint, url string").select("n", "url", F.timestamp_seconds("s").alias("ts"))
    found = sinks.nearest(spark.read.parquet(str(tmp_path / "index")), queries).collect()
    assert {r.n: r.nearest_id for r in found} == {0: 1, 1: 2, 2: 3, 3: 5, 4: None, 5: None, 6: 2} and len(found) == 7
    assert {r.key for r in found if r.n != 5} == {"org,a)/p"}
