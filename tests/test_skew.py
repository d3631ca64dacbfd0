import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.operators import ordered, skew


@pytest.fixture
def all_hot(monkeypatch):
    """No broadcast, and every key with a sizeable share counts as hot."""
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(skew, "HOT_ROWS", 10)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("keys", [["k"], ["k", "m"]])
def test_lookup_join_with_hot_keys(spark, all_hot, how, keys):
    # a third of all rows has k = 0
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("k"), (F.col("id") % 2).alias("m"))
    table = df.filter("k % 4 <> 3").select(*keys).distinct().withColumn("v", F.hash(*keys))
    assert skew.hot_keys(df, keys)
    joined = skew.lookup_join(df, table, keys, how, spread=["id"])
    assert rows_of(joined) == rows_of(df.join(table, keys, how))
    assert joined.columns == df.join(table, keys, how).columns


def test_lookup_join_broadcasts_only_what_fits(spark, monkeypatch):
    small = spark.range(10).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 100).alias("v"))
    assert skew.fits_broadcast(small)
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 500)
    assert not skew.fits_broadcast(small)


def test_hot_key_count_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 1)
    df = spark.range(100_000).select((F.col("id") % 1000).alias("k"))
    assert skew.hot_keys(df, ["k"]) == []  # each has a thousandth
    rows, hot = skew.key_profile(df.unionByName(spark.range(50_000).select(F.lit(7).cast("bigint").alias("k"))), ["k"])
    assert rows == 150_000 and len(hot) == 1


@pytest.mark.parametrize("n", [3, 25])
def test_first_n(spark, monkeypatch, n):
    monkeypatch.setattr(skew, "GROUP_LIMIT", 10)
    df = spark.range(2000).select("id", (F.col("id") * 37 % 101).alias("t"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("g"))
    got = skew.first_n(df, ["g"], [F.col("t"), F.col("id")], n, ["id"])
    rank = F.row_number().over(Window.partitionBy("g").orderBy("t", "id"))
    assert rows_of(got) == rows_of(df.withColumn("r", rank).filter(F.col("r") <= n).drop("r"))


@pytest.fixture
def bursts(spark):
    """Half of all rows share one timestamp."""
    seconds = F.when(F.col("id") % 2 == 0, 5000).otherwise(F.col("id") * 7919 % 90_000)
    return spark.range(4000).select(
        "id", F.timestamp_seconds(seconds + 1_700_000_000).alias("ts"), (F.col("id") * 31 % 97).alias("v"), (F.col("id") % 5 % 3).alias("g")
    ).repartition(6)


@pytest.mark.parametrize("per", [[], ["g"]])
def test_prefix_sum_equals_window(spark, bursts, per):
    got = ordered.prefix_sum(bursts, "v", ["ts", "id"], per)
    window = Window.partitionBy(*per).orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = bursts.withColumn("before", F.coalesce(F.sum("v").over(window), F.lit(0)))
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("limit", [0, 1000, 60_000, 150_000, 10**9])
@pytest.mark.parametrize("per", [[], ["g"]])
def test_running_cut_is_exact(spark, bursts, limit, per):
    window = Window.partitionBy(*per).orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = bursts.withColumn("b", F.coalesce(F.sum("v").over(window), F.lit(0))).filter(F.col("b") <= limit).drop("b")
    total = max(r.s for r in bursts.groupBy(*per).agg(F.sum("v").alias("s")).collect())
    got, hit = ordered.running_cut(bursts, F.col("v"), limit, ["ts", "id"], per)
    assert rows_of(got) == rows_of(want)
    assert hit == (total > limit)
