import pytest
from pyspark.sql import functions as F

from strandline.operators import quality, report, scope


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_crawl_stats_golden(spark):
    df = spark.range(35).select((F.col("id") >= 17).alias("failed"))
    row = report.crawl_stats(df).first()
    assert row.asDict(recursive=True) == {"crawled": 17, "pending": 0, "failed": 18, "total": 35, "limit": {"max": 0, "hit": False}}
    assert report.crawl_stats(df, page_limit=17).first()["limit"]["hit"]
    assert tuple(report.failed_limit(df, 17).first()) == (18, True)
    assert tuple(report.failed_limit(df, 18).first()) == (18, False)


def test_pending(spark):
    df = frame(spark, [("a", True, False), ("b", None, True), ("a", True, True)], "url string, pending boolean, failed boolean")
    assert report.crawl_stats(df).first()[:4] == (0, 2, 1, 3)
    assert [r.url for r in report.pending_pages(df).collect()] == ["a"]


def test_failed(spark):
    df = frame(spark, [(0,), (None,), (200,), (404,), (503,)], "status int")
    assert [r.failed for r in scope.with_failed(df).collect()] == [True, True, False, False, False]
    assert [r.failed for r in scope.with_failed(df, True).collect()] == [True, True, False, True, True]
    seeds = frame(spark, [(0, "https://h:443/a"), (1, "https://h/b")], "pos int, url string")
    pages = frame(spark, [("https://h/a", True), ("https://h/b", False)], "url string, failed boolean")
    assert [r.pos for r in report.failed_seeds(seeds, pages).collect()] == [0]


def test_outcomes(spark):
    rows = [
        (0, False, False, True, None), (100, False, False, False, None), (14, True, False, True, None), (14, False, True, True, None),
        (15, False, True, False, None), (15, True, False, True, None), (2, True, True, True, None), (3, False, False, True, None),
        (9, False, False, True, "8, 9"), (9, False, False, True, "8"), (2, False, False, True, "2"),
    ]
    df = frame(spark, rows, "exit_code int, soft_size boolean, soft_time boolean, has_progress boolean, accepted_codes string")
    got = [(r.outcome, r.final_code, r.partial_flag) for r in report.classify_runs(df).collect()]
    assert got == [
        ("complete", 0, False), ("complete", 0, None), ("partial", 0, True), ("failed", 14, None), ("partial", 0, None), ("failed", 15, None),
        ("rejected", 2, None), ("failed", 3, None), ("partial", 0, True), ("failed", 9, None), ("partial", 0, True),
    ]
    bare = report.classify_runs(df.select("exit_code"))
    assert {r.outcome for r in bare.collect()} == {"complete", "failed", "rejected"}


def test_progress_golden(spark):
    crawl = frame(spark, [(1, 17, 35), (0, 3, None)], "ts bigint, crawled bigint, total bigint")
    convert = frame(spark, [(2, 3, 6), (3, 6, 6), (4, 5, 0), (5, None, 6)], "ts bigint, written bigint, total bigint")
    none = convert.filter("false")
    assert tuple(report.progress(crawl, none).first()) == (17, 38)
    assert tuple(report.progress(crawl, convert.filter("ts = 2")).first()) == (5, 6)
    assert tuple(report.progress(crawl, convert).first()) == (6, 6)
    assert tuple(report.progress(crawl, convert, partial=False).first()) == (6, 6, False)
    assert report.progress(crawl.filter("false"), convert.filter("ts > 3")).count() == 0
    empty_crawl = frame(spark, [(1, 0, 0)], "ts bigint, crawled bigint, total bigint")
    assert tuple(report.progress(empty_crawl, none).first()) == (0, 0)  # a crawl that has found nothing yet


def test_progress_agrees_with_plain_arithmetic(spark):
    pairs = [(w, t) for t in range(1, 60) for w in range(t + 1)]
    got = {(r.w, r.t): r.done for r in report.convert_progress(frame(spark, pairs, "w bigint, t bigint").select("w", "t", F.col("w").alias("written"), F.col("t").alias("total"))).collect()}
    assert got == {(w, t): int(t * (0.9 + (float(w) / t) / 10)) for w, t in pairs}
    got = {r.n: r.total for r in report.crawl_progress(frame(spark, [(n, n, n) for n in range(500)], "n bigint, crawled bigint, total bigint")).collect()}
    assert got == {n: int(n / 0.9) for n in range(500)}


def test_user_agents(spark):
    good, bare = "Mozilla/5.0 +Bot a@b.c", "Mozilla/5.0+Bot a@b.c"
    rows = [("ok", "request", good), ("ok", "response", "x"), ("ok", "request", None), ("bad", "request", bare), ("bad", "request", "curl +Bot a@b.c"), ("none", "request", "")]
    df = frame(spark, rows, "collection string, rec_type string, user_agent string")
    suffix = report.user_agent_suffix("+Bot", "a@b.c")
    got = {r.collection: tuple(r)[1:] for r in report.ua_audit(df, suffix).collect()}
    assert got == {"ok": (1, 0, 0, True), "bad": (2, 1, 1, False), "none": (0, 0, 0, False)}
    assert report.user_agent_suffix("+Bot") == "+Bot"
    ua = frame(spark, [("  x ",), ("  ",), (None,)], "ua string").select(report.effective_user_agent("ua").alias("v")).collect()
    assert [r.v for r in ua] == ["x", None, None]


def test_charsets(spark):
    meta = b'<html><head><meta http-equiv="x" content="text/html; charset=ISO-8859-1">'
    rows = [
        ("text/html; charset=utf-8", "é".encode()), ("text/html; charset=utf-8", "é".encode("latin-1")), ("text/html", meta + b"\xe9"),
        ("text/html", "é".encode()), ("text/html", b"\xe9"), ("text/html; charset=foo", b"abc"), (None, b" " * 2000 + meta),
        ("text/html; charset=Latin9", b"\xe9"), ("text/html; charset=utf-16", b"abc"), ("text/html; charset=us-ascii", b"\xe9"),
    ]
    df = frame(spark, list(enumerate(rows)), "i int, r struct<content_type string, body binary>").select("i", "r.*")

    def found(**options):
        return [(r.charset, r.charset_source, r.decodable) for r in report.charsets(df, **options).orderBy("i").collect()]

    plain = found()
    assert plain == [
        ("utf-8", "http", True), ("utf-8", "http", False), ("iso-8859-1", "content", True), ("utf-8", "tried", True), ("iso-8859-1", "tried", True),
        ("foo", "http", None), ("utf-8", "tried", True), ("latin9", "http", None), ("utf-16", "http", False), ("us-ascii", "http", False),
    ]
    assert found(ignore_unknown=True)[5] == ("utf-8", "tried", True)
    assert found(aliases={"latin9": "iso-8859-1"})[7] == ("iso-8859-1", "http", True)
    assert found(header_bytes=4000)[6] == ("iso-8859-1", "content", True)
    assert found(ignore_http=True)[1] == ("iso-8859-1", "tried", True)
    assert found(ignore_content=True, to_try=["UTF-8"])[2] == (None, "none", None)
    report_rows = report.charset_audit(df.withColumn("host", F.lit("h"))).collect()
    assert sum(r.captures for r in report_rows) == 10 and sum(r.untested for r in report_rows) == 2


def test_site_metadata(spark):
    pages = frame(
        spark,
        [("http://a/1", '<html lang="fr-CA"><title> Un\n titre &amp; </title>'), ("http://a/2", "<html lang='de'><title>x</title>"), ("http://b/", "<html><body>")],
        "url string, html string",
    )
    seeds = frame(spark, [(1, "http://a/2"), (0, "http://a/1"), (2, "http://b/"), (3, "http://c/")], "pos int, url string")
    overrides = frame(spark, [("b", "Given", "por")], "site string, title string, language string")
    got = {r.site: (r.homepage, r.Title, r.Language, r.Name) for r in report.site_metadata(pages, seeds, overrides).collect()}
    assert got == {"a": ("http://a/1", "Un titre &", "fra", "a"), "b": ("http://b/", "Given", "por", "b"), "c": ("http://c/", None, "eng", "c")}
    assert report.site_metadata(pages, seeds).columns[2:] == [n for n, _ in report.METADATA]


EXPECTED = """h.org/http-return-codes.html h.org/200-response h.org/301-internal-redirect-ok h.org/icons/favicon.ico
www.example.com/ h.org/200-response"""


def test_missing_entries(spark):
    expected = frame(spark, [(p,) for p in EXPECTED.split()], "path string")
    entries = frame(spark, [("h.org/200-response", 5), ("h.org/icons/favicon.ico", 0), ("www.example.com/", 9), ("www.example.com/", 9)], "path string, bytes bigint")
    got = {r.path for r in quality.missing_entries(expected, entries).collect()}
    assert got == {"h.org/http-return-codes.html", "h.org/301-internal-redirect-ok", "h.org/icons/favicon.ico"}


def test_recipes(spark):
    family = "\U0001f468‍\U0001f469‍\U0001f467"  # one grapheme, five characters
    rows = [
        (1, "site_en_all", "t", "1", "prefix", "a@b.org", "true", "site_en_all_2024-05.arc"),
        (2, None, "", "0", "planet", "nobody", "maybe", "Bad name.arc"),
        (3, "Site_en_all", "é" * 30, "x", None, None, None, "site_en_all_{period}.arc"),
        (4, "site_en_all", family * 31, "2", "page-spa", None, "FALSE", None),
    ]
    df = frame(spark, rows, "recipe_id int, name string, title string, workers string, scope_type string, admin_email string, overwrite string, archive_file string")
    got = {tuple(r) for r in quality.check_recipes(df, quality.recipe_rules("arc")).collect()}
    assert got == {
        (2, "name", "required"), (2, "title", "min_graphemes"), (2, "workers", "min"), (2, "scope_type", "choices"), (2, "admin_email", "type"),
        (2, "overwrite", "type"), (2, "archive_file", "pattern"), (3, "name", "pattern"), (3, "workers", "type"), (4, "title", "max_graphemes"),
    }
    relaxed = {tuple(r) for r in quality.check_recipes(df, quality.recipe_rules("arc"), strict=False).collect()}
    assert (3, "name", "pattern") not in relaxed and (2, "archive_file", "pattern") in relaxed
    nameless = quality.check_recipes(df.drop("name"), quality.recipe_rules("arc")).filter("constraint = 'required'")
    assert nameless.count() == 4


def test_qa_compare(spark):
    crawl = frame(spark, [("http://h:80/a", "one two two"), ("http://h/b", "x"), ("http://h/c", "")], "url string, text string")
    replay = frame(spark, [("http://h/a", "Two three"), ("http://h/d", "y"), ("http://h/c", "")], "url string, text string")
    got = {r.url: tuple(r)[1:] for r in quality.qa_compare(crawl, replay).collect()}
    assert got == {
        "http://h/a": ("both", False, 818, 1, 3), "http://h/b": ("crawl_only", None, None, None, None),
        "http://h/d": ("replay_only", None, None, None, None), "http://h/c": ("both", True, None, 0, 0),
    }
