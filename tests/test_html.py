"""Hostile pages end in time, and text and links are what a reader gets."""

import time

import pytest

from strandline.functions import html as H
from strandline.operators import graph, quality, report
from strandline.sources import sinks

HOSTILE = ["<!--", "<script>", "<style>", "<", "<a ", '<a "', "<a '\"", "</script ", "<title>", "<html", "&#", "<a href=", "<!-- <script>"]


@pytest.mark.parametrize("piece", HOSTILE)
def test_two_megabytes_in_two_seconds(spark, piece):
    page = piece * (2_000_000 // len(piece))
    df = spark.createDataFrame([("http://h.org/", page)], "url string, html string").cache()
    df.count()
    start = time.process_time()
    began = time.time()
    df.select(H.text_of(df.html), H.title(df.html), H.language(df.html), H.link_values(df.html, "a[href]->href")).collect()
    assert time.time() - began < 20 and time.process_time() - start < 2
    df.unpersist()


def text(spark, page):
    return sinks.page_text(spark.createDataFrame([("http://h/", page)], "url string, html string")).first().text


@pytest.mark.parametrize(
    "page, want",
    [
        ("caf&eacute; &#8217;x &#x2F; &amp;lt; &nosuch; &#0; &#xD800; &#128; &Auml;", "café ’x / &lt; &nosuch; � � € Ä"),
        ("<p title='a>b'>x</p>", "x"),
        ("a < b > c", "a < b > c"),
        ("before<!-- never closed <p>no</p>", "before"),
        ("<script>a</script >b<SCRIPT>c</Script x>d", "b d"),
        ("a&nbsp;&nbsp;b ", "a b"),
        ("one <b", "one"),
        ("&&amp;&;", "&&&;"),
        ("", ""),
        (None, None),
    ],
)
def test_text(spark, page, want):
    assert text(spark, page) == want


def test_selectors_and_base(spark):
    page = """<base target=x><base href="/c/"><a class="big nav" href=d>1</a><a id=top href='e'>2</a><area shape="rect" href="f">
    <a data-x="<a class='nav' href='no'>" href="g">3</a>"""
    df = spark.createDataFrame([("http://h.org/a/b", page), ("http://h.org/a/", "<a href=z>")], "url string, html string")

    def found(*rules):
        return sorted(r.dst for r in graph.extract_links(df, rules).collect())

    assert found("a.nav->href") == ["http://h.org/c/d"]
    assert found("#top->@href", "area[shape=rect]->href") == ["http://h.org/c/e", "http://h.org/c/f"]
    assert found('*[shape="rect"][href]->href') == ["http://h.org/c/f"]
    assert found("a[href]->href") == ["http://h.org/a/z", "http://h.org/c/d", "http://h.org/c/e", "http://h.org/c/g"]
    for rule in ("div a->href", "a>b->href", "->href", "a:hover->href"):
        with pytest.raises(ValueError):
            H.link_values(df.html, rule)


@pytest.mark.parametrize("declared, want", [("fil", "fil"), ("ger", "deu"), ("FR-ca", "fra"), ("", "eng"), ("q", "eng")])
def test_language_codes(spark, declared, want):
    pages = spark.createDataFrame([("http://a/", f"<html lang='{declared}'>")], "url string, html string")
    start = spark.createDataFrame([(0, "http://a/")], "pos bigint, url string")
    assert report.site_metadata(pages, start).first()["Language"] == want
    given = spark.createDataFrame([("a", "fr")], "site string, language string")
    assert report.site_metadata(pages, start, given).first()["Language"] == "fra"


def test_qa_takes_one_row_per_cleaned_url(spark):
    sides = [("http://a/x", "one two", 1), ("HTTP://a/x", "one", 2)], [("http://a/x#", "one", 1), ("http://a:80/x", "one two three", 0)]
    frames = [spark.createDataFrame(s, "url string, text string, ts int") for s in sides]
    assert [(r.shared, r.tokens) for r in quality.qa_compare(*frames).collect()] == [(2, 3)]
    assert [(r.shared, r.tokens, r.same_text) for r in quality.qa_compare(*frames, ts="ts").collect()] == [(1, 1, True)]
