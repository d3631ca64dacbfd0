"""Device and language rules, charsets, bracketed hosts, saved states, scratch."""

import os

import pytest
from pyspark.sql import functions as F

from strandline.functions import urls as U
from strandline.operators import quality, report
from strandline.session import scratch_scope, work_dir, written
from strandline.sources import seeds, states


def test_device_and_language_rules(spark):
    rows = [(1, "Pixel 5", "eng"), (2, "pixel 5", "fra,deu"), (3, None, "fr"), (4, "Moto G4 landscape", "Eng")]
    recipes = spark.createDataFrame([(i, "a_b_c", d, g) for i, d, g in rows], "recipe_id int, name string, mobile_device string, language string")
    found = {tuple(r) for r in quality.check_recipes(recipes, quality.recipe_rules("arc")).collect()}
    assert found == {(2, "mobile_device", "choices"), (3, "language", "type"), (4, "language", "type")}


@pytest.mark.parametrize("charset", ["utf-16", "utf-16be", "utf-16le", "utf-32"])
def test_wide_charsets(spark, charset):
    texts = ["", "abc é 🎉", "퟿￿"]
    bodies = [t.encode(charset) for t in texts] + [b"a", b"\xd8\x00\xd8\x00", b"\x00\xd8\x41\x00", b"\x00\xdc\x00\xdc", b"\xff\xfe\x00\xd8", b"\xff\xff\xff\xff", b"\x00\x00\x11\x00"]

    def sound(body):
        try:
            body.decode(charset)
        except UnicodeDecodeError:
            return False
        return True

    df = spark.createDataFrame([(f"text/plain; charset={charset}", b) for b in bodies], "content_type string, body binary")
    found = report.charsets(df).collect()
    assert [r.decodable for r in found] == [sound(b) for b in bodies]


@pytest.mark.parametrize("url", ["http://[zz]/", "http://a[b]c/", "http://[::1]x/", "http://[1:2]/", "http://ex℀mple.org/", "http://a／b/", "http://[::1::2]/"])
def test_urls_refused(spark, url):
    assert spark.createDataFrame([(url,)], "url string").select(U.clean_url("url").alias("u")).first().u is None


@pytest.mark.parametrize(
    "url", ["http://[::1]/", "http://[2001:db8::8:800:200c:417a]:8080/x", "http://u@[::ffff:1.2.3.4]/", "http://[v1.x]/", "http://é.org/", "http://a/[b]", "http://[fe80::1%25en]/"]
)
def test_urls_accepted(spark, url):
    assert spark.createDataFrame([(url,)], "url string").select(U.clean_url("url").alias("u")).first().u == url


def test_half_written_states_are_not_loaded(spark, tmp_path):
    pending = spark.createDataFrame([("http://a/",)], "url string")
    for n in (1, 2):
        pending.union(pending.limit(n - 1)).write.parquet(f"{tmp_path}/c/state-{n:020d}")
    os.remove(f"{tmp_path}/c/state-{2:020d}/_SUCCESS")
    assert states.load_state(spark, str(tmp_path), "c").count() == 1
    assert states.load_state(spark, str(tmp_path), "other") is None


def test_scratch_goes_after_errors_too(spark):
    folder = work_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    with pytest.raises(KeyError), scratch_scope(spark):
        assert written(spark.range(3), "kept").count() == 3
        assert set(os.listdir(folder)) - before
        raise KeyError
    assert set(os.listdir(folder)) == before


def test_runs_in_nested_folders(spark, tmp_path):
    spark.range(2).write.parquet(f"{tmp_path}/a/collections/crawl-1/archive")
    assert seeds.union_collections(spark, str(tmp_path)).filter(F.col("collection") == "crawl-1").count() == 2
