import datetime

from pyspark.sql import functions as F

from strandline.functions import urls as U
from strandline.plans.archive_build import Recipe, decide

TIME = datetime.datetime(2024, 1, 1)


def test_allowed_captures_are_worked_out_once(spark):
    """URLs were cleaned and tested anew for each join over the captures."""
    done = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def costly(url):
        done.add(1)
        return url

    rows = [(i, TIME + datetime.timedelta(seconds=i), f"https://a.org/{i % 10}", 200 if i % 3 else 500, 10, None, i // 10 + 1) for i in range(60)]
    captures = spark.createDataFrame(rows, "capture_id bigint, ts timestamp, url string, status int, bytes bigint, digest string, attempt bigint")
    seeds = spark.createDataFrame([(0, "https://a.org/0")], "pos bigint, url string")
    links = spark.createDataFrame([(f"https://a.org/{i}", f"https://a.org/{i + 1}") for i in range(4)], "src string, dst string")
    recipe = Recipe(output="", scope_type="host", max_retries=1, invalid_status_fails=True)
    kept = decide(captures.withColumn("url", costly("url")), seeds, recipe, links)
    best = {}
    for i, _, url, status, _, _, attempt in rows:
        if int(url[-1]) < 5 and attempt <= 2 and (url not in best or best[url][1] >= 400):
            best[url] = i, status
    assert sorted(r.capture_id for r in kept.collect()) == sorted(i for i, _ in best.values())
    assert done.value == len(rows)


def test_unusable_is_what_cleaning_gives_up(spark):
    urls = [
        None, "", "https://a.org/x", "https://a.org:443/x", "https://a.org:99999/", "http://a.org:x/", " https://a.org:70000/ ", "https://[::1]/", "https://[::1/",
        "https://a]b/", "https://u@[::1]:80/", "https://[zz]/", "https://a℀b.org/", "https://ü.org/", "https://a.org/?q=[1]", "https://a.org/]", "ftp://[x", "h[",
        "https://a[::1]/", "\thttps://a.org:8 0/", "https://a.org/℀", "HTTPS://A.org:65536/#", "mailto:x@[y]",
    ]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    rows = df.select("url", U.unusable("url").alias("bad"), U.clean_url("url").alias("clean")).collect()
    assert [r.bad for r in rows] == [r.url is not None and r.clean is None for r in rows] and sum(r.bad for r in rows) > 6
