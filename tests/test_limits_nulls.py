"""Limits give the same rows on both sides of every size switch, nulls included."""

import itertools
import random

import pytest

from strandline.operators import ordered, scope
from strandline.sources import seeds, sinks

SCHEMA = "capture_id bigint, ts timestamp_ntz, collection string, bytes bigint, body string"


def rows(seed, count=60):
    import datetime as dt

    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    times = [None if rng.random() < 0.15 else start + dt.timedelta(minutes=20 * rng.randint(0, 30)) for _ in range(count)]
    return [(i, t, rng.choice([None, "a", "b"]), rng.randint(0, 9), "x" * 50) for i, t in enumerate(times)]


def first_come(given, per=False):
    groups = {}
    for row in sorted(given, key=lambda r: (r[1] is not None, r[1] or 0, r[0])):
        groups.setdefault(row[2] if per else 0, []).append(row)
    return groups.values()


def ids(df):
    return sorted(r.capture_id for r in df.collect())


@pytest.mark.parametrize("per", [(), ("collection",)])
@pytest.mark.parametrize("limit", [1, 4, 17, 200])
def test_page_limit_on_either_side(spark, per, limit):
    given = rows(limit)
    df = spark.createDataFrame(given, SCHEMA).repartition(4)
    want = sorted(r[0] for g in first_come(given, bool(per)) for r in g[:limit])
    assert ids(scope.page_limit(df, limit, per=per)) == want
    assert ids(scope.page_limit(df, limit, per=per, top_k=0)) == want


@pytest.mark.parametrize("per", [(), ("collection",)])
@pytest.mark.parametrize("limit", [0, 20, 90, 10_000])
def test_byte_cut(spark, per, limit):
    given = rows(limit + 1)
    df = spark.createDataFrame(given, SCHEMA).repartition(4)
    want = []
    for group in first_come(given, bool(per)):
        before = itertools.accumulate((r[3] for r in group), initial=0)
        want += [r[0] for r, b in zip(group, before) if b <= limit]
    kept, hit = ordered.running_cut(df, scope.F.col("bytes"), limit, ("ts", "capture_id"), per)
    assert ids(kept) == sorted(want) and kept.columns == df.columns
    assert hit == (len(want) < len(given))


def test_prefix_sum_keeps_null_groups(spark):
    given = rows(5)
    df = spark.createDataFrame(given, SCHEMA).select("capture_id", "ts", "collection", "bytes")
    found = {r.capture_id: r.before for r in ordered.prefix_sum(df, "bytes", ("ts", "capture_id"), ("collection",)).collect()}
    want = {r[0]: b for g in first_come(given, True) for r, b in zip(g, itertools.accumulate((r[3] for r in g), initial=0))}
    assert found == want


def test_elapsed_keeps_rows_without_time(spark):
    given = rows(6)
    kept, hit = scope.limit_cut(spark.createDataFrame(given, SCHEMA), 3600, by="elapsed")
    first = min(r[1] for r in given if r[1])
    assert hit and ids(kept) == sorted(r[0] for r in given if r[1] is None or (r[1] - first).total_seconds() <= 3600)


def test_rollover_stores_no_bodies(spark, monkeypatch):
    stored = []
    add = ordered.BucketedTable.add
    monkeypatch.setattr(ordered.BucketedTable, "add", lambda self, df, **k: stored.append(df.columns) or add(self, df, **k))
    given = rows(7)
    found = {r.capture_id: r.shard for r in sinks.rollover(spark.createDataFrame(given, SCHEMA), 50).collect()}
    (group,) = first_come(given)
    assert found == {r[0]: b // 50 for r, b in zip(group, itertools.accumulate((r[3] for r in group), initial=0))}
    assert stored == [["ts", "capture_id", "bytes", "pid"]]


def test_logs_without_context_stay(spark):
    logs = spark.createDataFrame([("info", None), ("info", "general"), ("info", "screencast")], "level string, context string")
    assert seeds.filter_logs(logs, exclude="screencast").count() == 2


def test_unreadable_bounds_are_errors(spark):
    df = spark.createDataFrame([("2024-01-01",)], "lastmod string")
    with pytest.raises(ValueError):
        scope.sitemap_between(df, "May 2020")


@pytest.mark.parametrize("literal", [1_000, 0])
def test_include_widens_a_named_scope(spark, monkeypatch, literal):
    monkeypatch.setattr(scope, "LITERAL_KEYS", literal)
    urls = ["https://a.org/x/1", "https://a.org/y/2", "https://b.org/x/3", "https://c.org/keep/4", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    start = spark.createDataFrame([("https://a.org/x/",)], "url string")
    for kind, want in (("prefix", [0, 3]), ("host", [0, 1, 3]), ("custom", [3]), (None, [3])):
        found = scope.in_scope(df, start, kind, include="/keep/")
        assert sorted(r.url for r in found.collect()) == [urls[i] for i in want]
