"""Row-position bitmaps, member offset indexes, index lookup, greedy shards, redirects
on the way, files packed by size."""

import glob
import gzip
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

from strandline.operators import graph, positions, rank, scope, skew
from strandline.plans import archive_build
from strandline.plans.archive_build import Recipe, build_archive
from strandline.sources import seeds, sinks, warc


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return [line for line in plan(df).splitlines() if "Exchange" in line and "BroadcastExchange" not in line]


# --- positions ---------------------------------------------------------------


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "captures")
    rows = spark.range(0, 100_000, 1, 3).select(
        F.col("id").alias("capture_id"), F.timestamp_seconds(F.col("id") * 7 % 100_003).alias("ts"), F.concat(F.lit("https://h.org/"), F.col("id") % 900).alias("url"),
        F.lit(200).alias("status"), (F.col("id") % 50).alias("bytes"), F.concat(F.lit("d"), F.col("id") % 1_800).alias("digest"), F.repeat(F.lit("body"), 5).alias("body"),
    )
    rows.write.parquet(path)
    return path


@pytest.mark.parametrize("bound", [32 << 20, 30_000])
def test_positions_choose_rows(spark, stored, monkeypatch, bound):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", bound)
    found = positions.located(spark.read.parquet(stored))
    chosen = found.filter("capture_id % 7 = 3 or capture_id < 9 or capture_id > 99990")
    marks = positions.bitmaps(chosen, kept=F.lit(True), odd=F.col("capture_id") % 2 == 1)
    parts = list(positions.selected(found, marks, "kept"))
    assert (len(parts) > 1) == (bound == 30_000)
    rows = [tuple(r) for p in parts for r in p.select("capture_id", "odd").collect()]
    assert sorted(rows) == [(i, i % 2 == 1) for i in range(100_000) if i % 7 == 3 or i < 9 or i > 99_990]


def test_only_scans_have_positions(spark, stored):
    df = spark.read.parquet(stored)
    assert positions.located(df.filter("bytes > 3").withColumn("x", F.lit(1))) is not None
    for other in (df.withColumn("x", F.explode(F.array(F.lit(1), F.lit(2)))), df.unionByName(df), df.join(df.select("url"), "url"), df.repartition(3), spark.range(3)):
        assert positions.located(other) is None


def test_no_body_in_the_exchanges(spark, stored, tmp_path):
    df = spark.read.parquet(stored)
    wide, thin = rank.dedup(df), rank.dedup(df.select("capture_id", "ts", "url", "digest"))
    assert not exchanges(wide) and "body" in wide.columns
    assert sorted(r.capture_id for r in wide.select("capture_id").collect()) == sorted(r.capture_id for r in thin.collect())

    start = spark.createDataFrame([(0, "https://h.org/")], "pos int, url string")
    recipe = Recipe(str(tmp_path / "out"), buckets=2, exclude=["/8[0-9]$"])
    found = positions.located(df)
    allowed = archive_build.candidates(found, start, recipe)
    kept = archive_build.decide(allowed, start, recipe)
    (part,) = archive_build.picked(found, kept, recipe)
    assert "body" in part.columns and not exchanges(part)
    placed = part.withColumn("host_bucket", F.lit(1)).hint("rebalance", "host_bucket")
    assert len(exchanges(placed)) == 1  # that of the writer
    assert build_archive(df, start, recipe).stats["total"] == part.count() == allowed.select("url", "digest").distinct().count()


@pytest.mark.parametrize("policy", ["skip", "revisit"])
def test_archives_by_position_and_by_id_are_alike(spark, tmp_path, policy):
    rows = [
        (1, 0, "https://a.org/", 200, 40, "x", "one"), (2, 5, "https://a.org:443/x", 200, 40, "y", "two"), (3, 6, "https://a.org/y?", 200, 40, "z", "BUY"),
        (4, 7, "https://a.org/x#t", 200, 40, "y", "two"), (5, 8, "https://a.org:99999/", 200, 1, "v", "bad"), (6, 9, None, 200, 1, "u", "none"), (7, 9, "https://ads.org/", 200, 4, "t", "ad"),
    ]
    df = spark.createDataFrame(rows, "capture_id bigint, t bigint, url string, status int, bytes bigint, digest string, text string")
    df = df.select("*", F.timestamp_seconds("t").alias("ts")).drop("t")
    path = str(tmp_path / "captures")
    df.repartition(2).write.parquet(path)
    start = spark.createDataFrame([(0, "https://a.org/")], "pos int, url string")
    links = spark.createDataFrame([("https://a.org/", "https://a.org/x"), ("https://a.org:443/", "https://a.org/y"), ("https://a.org/", "https://ads.org/")], "src string, dst string")
    hosts = spark.createDataFrame([("ads.org",)], "host string")
    out = []
    for n, source in enumerate((df, spark.read.parquet(path))):
        recipe = Recipe(str(tmp_path / f"out{n}"), buckets=2, scope_type="any", dedup_policy=policy, block_rules=[scope.BlockRule("/y", "BUY")], block_message="gone", ad_message="ad")
        built = build_archive(source, start, recipe, hosts, links)
        assert built.bad_urls == 1
        found = spark.read.parquet(recipe.output)
        names = ["capture_id", "url", "raw_url", "text", "bytes", "digest"] + ["revisit_of"] * (policy == "revisit")
        out.append(sorted(tuple(r) for r in found.select(names).collect()))
        assert "row_at" not in found.columns and "rule_blocked" not in found.columns
    assert out[0] == out[1]
    urls = {r[0]: (r[1], r[2], r[3]) for r in out[0]}
    assert urls[2] == ("https://a.org/x", "https://a.org:443/x", "two") and urls[3] == ("https://a.org/y", "https://a.org/y?", "gone") and urls[7][2] == "ad"
    assert set(urls) == ({1, 2, 3, 7} if policy == "skip" else {1, 2, 3, 4, 7})


def test_run_follows_redirects_and_leaves_shards_and_pages(spark, tmp_path):
    rows = [
        (1, "https://s.org/", 301, 10, "/home", None), (2, "https://s.org/home", 200, 30, None, "<p>home"), (3, "https://s.org/old", 308, 10, "https://s.org/mid", None),
        (4, "https://s.org/mid", 302, 10, "new", None), (5, "https://s.org/new", 200, 30, None, "<p>new"), (6, "https://s.org/loop", 307, 10, "/loop2", None),
        (7, "https://s.org/loop2", 301, 10, "/loop", None), (8, "https://s.org/far", 200, 30, None, "<p>far"),
    ]
    df = spark.createDataFrame(rows, "capture_id bigint, url string, status int, bytes bigint, redirect_to string, html string")
    df = df.withColumns({"ts": F.timestamp_seconds("capture_id"), "digest": F.col("url"), "rec_type": F.lit("request"), "collection": F.lit("c"), "user_agent": F.lit("Mozilla +Bot")})
    start = spark.createDataFrame([(0, "https://s.org/")], "pos int, url string")
    links = [("https://s.org/home", "https://s.org/old"), ("https://s.org/home", "https://s.org/loop"), ("https://s.org/new", "https://s.org/far"), ("https://s.org/", "https://s.org/far")]
    recipe = Recipe(str(tmp_path / "out"), buckets=1, depth=1, text=True, rollover_size=60, user_agent_suffix="+Bot")
    built = build_archive(df, start, recipe, links=spark.createDataFrame(links, "src string, dst string"))
    kept = {r.capture_id for r in spark.read.parquet(recipe.output).collect()}
    assert kept == {1, 2, 3, 4, 5, 6, 7}  # far is two hops away, and a redirect's own links are not followed
    assert {r.text for r in spark.read.json(recipe.output + "-pages").collect()} >= {"home", "new"}
    assert [(r.shard, r.capture_id) for r in spark.read.parquet(recipe.output + "-shards").orderBy("shard").collect()] == [(0, 1), (1, 5)]
    assert built.user_agents.first().passed and built.stats["total"] == 7


# --- graph -------------------------------------------------------------------


@pytest.mark.parametrize("depth", [-1, 2])
def test_reach_redirected(spark, depth):
    rng = random.Random(depth)
    for _ in range(1):
        nodes = [f"u{i}" for i in range(40)]
        moves = {n: rng.choice(nodes) for n in rng.sample(nodes, 18)}
        edges = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(60)}
        start = rng.sample(nodes, 2)

        def end(n, moves=moves):
            seen = [n]
            while seen[-1] in moves and moves[seen[-1]] != seen[-1]:
                if moves[seen[-1]] in seen:
                    return n  # a loop
                seen.append(moves[seen[-1]])
            return seen[-1]

        shown = {(a, b) for a, b in edges if end(a) == a and (a not in moves or moves[a] == a)}
        best, front, met, level = {end(s): 0 for s in start}, {end(s) for s in start}, {s: 0 for s in start}, 0
        while front and level != depth:
            level += 1
            targets = {b for a, b in shown if a in front}
            for b in targets:
                met.setdefault(b, level)
            front = {end(b) for b in targets} - set(best)
            best |= dict.fromkeys(front, level)
        via = {}
        for n, at in met.items():
            while n in moves and moves[n] != n and via.get(n, at + 1) > at:
                via[n] = at
                n = moves[n]
        want = {(n, d, False) for n, d in best.items()} | {(n, d, True) for n, d in via.items() if n not in best}
        found = graph.reach_redirected(
            spark.createDataFrame([(s,) for s in start], "url string"), spark.createDataFrame(list(edges), "src string, dst string"),
            spark.createDataFrame(list(moves.items()), "src string, dst string"), depth,
        ).collect()
        assert {(r.url, r.depth, r.via) for r in found} == want and len(found) == len(want)


def test_reach_closes_its_tables_after_errors(spark):
    links = spark.createDataFrame([("a", "b")], "src string, dst string")
    before = {t.name for t in spark.catalog.listTables()}
    with pytest.raises(Exception):
        graph.reach(spark.createDataFrame([("a",)], "url string").select(F.raise_error(F.lit("no")).cast("string").alias("url")), links)
    assert {t.name for t in spark.catalog.listTables()} == before


# --- WARC --------------------------------------------------------------------


def record(n, body=None):
    body = f"body {n} ".encode() * (n % 9) if body is None else body
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\n" + body
    kind = b"request" if n % 4 == 0 else b"response"
    head = b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Target-URI: http://h%d.org/%d\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % (kind, n % 2, n, len(http))
    return head + http + b"\r\n\r\n"


@pytest.fixture(params=[".warc", ".warc.gz"])
def one_file(request, tmp_path):
    path = str(tmp_path / ("big" + request.param))
    odd = [record(200, b"WARC/1.1\r\n\r\nWARC/1.1\r\n\r\n"), record(201, gzip.compress(record(1))), record(202, os.urandom(5_000))]
    with open(path, "wb") as out:
        for data in [*map(record, range(200)), *odd]:
            out.write(gzip.compress(data) if path.endswith("gz") else data)
    return path


def test_one_file_by_many_tasks(spark, one_file):
    warc.register(spark)
    whole = spark.read.format("warc").load(one_file)
    columns = ["url", "rec_type", "capture_id", "body"]
    want = Counter(tuple(r) for r in whole.select(columns).collect())
    assert sum(want.values()) == 203 and whole.rdd.getNumPartitions() == 1
    assert [tuple(r)[1] for r in warc.write_offsets(spark, one_file).collect()] == [203]
    size = os.path.getsize(one_file)
    parts = spark.read.format("warc").option("taskBytes", size // 300).load(one_file)
    assert parts.rdd.getNumPartitions() >= 8
    assert Counter(tuple(r) for r in parts.select(columns).collect()) == want
    eight = warc.WarcReader({"path": one_file, "taskBytes": str(-(-size // 8))}).partitions()
    assert [p.parts[0][3] for p in eight] == sorted({p.parts[0][3] for p in eight}) and eight[-1].parts[0][2] == size


def test_equal_records_are_split_evenly(spark, tmp_path):
    warc.register(spark)
    path = str(tmp_path / "even.warc")
    with open(path, "wb") as out:
        out.write(record(101, b"x" * 100) * 200)
    warc.write_offsets(spark, path)
    tasks = spark.read.format("warc").option("taskBytes", os.path.getsize(path) // 8).load(path)
    counts = [r.n for r in tasks.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(counts) in (8, 9) and sum(counts) == 200 and max(counts) <= 26


def test_sink_writes_offsets_and_odd_members_have_none(spark, tmp_path):
    warc.register(spark)
    out = str(tmp_path / "out")
    spark.range(50).select(F.lit("response").alias("rec_type"), F.concat(F.lit("http://h/"), "id").alias("url"), F.encode(F.lit("x"), "UTF-8").alias("body")).coalesce(1).write.format("warc").mode("append").save(out)
    (name,) = glob.glob(out + "/*.warc.gz")
    assert list(warc.read_offsets(name)) == list(warc.member_offsets(name)) and len(warc.read_offsets(name)) == 52
    odd = str(tmp_path / "odd.warc.gz")
    with open(odd, "wb") as file:
        file.write(gzip.compress(record(1) + record(2)))
    assert warc.write_offsets(spark, odd).first().records is None and not os.path.exists(odd + warc.OFFSETS)
    assert spark.read.format("warc").option("taskBytes", 10).load(odd).count() == 2


def test_filters_reach_the_reader(spark, one_file):
    warc.register(spark)
    reader = warc.WarcReader({"path": one_file})
    rest = list(reader.pushFilters([EqualTo(("rec_type",), "response"), In(("url",), ("a", "b")), StringStartsWith(("url",), "a"), GreaterThan(("bytes",), 1), EqualTo(("status",), 200)]))
    assert [type(f).__name__ for f in rest] == ["GreaterThan", "EqualTo"]
    assert reader.wanted("response", "a") and not reader.wanted("request", "a") and not reader.wanted("response", "c") and not reader.wanted("response", None)
    df = spark.read.format("warc").load(one_file)
    some = df.filter("rec_type = 'response' and url like 'http://h1%' and bytes > 10")
    assert "rec_type" not in plan(some).split("BatchScan")[0].split("Filter")[-1] if "Filter" in plan(some) else True
    rows = df.select("rec_type", "url", "bytes").collect()
    assert some.count() == sum(r.rec_type == "response" and r.url.startswith("http://h1") and r.bytes > 10 for r in rows) > 0


# --- index and shards --------------------------------------------------------


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "index")
    hot = F.when(F.col("id") % 3 == 0, F.lit("https://hot.org/")).otherwise(F.concat(F.lit("https://h"), F.col("id") % 40, F.lit(".org/p"), F.col("id") % 7))
    rows = spark.range(6_000).select(F.col("id").alias("capture_id"), F.timestamp_seconds(F.col("id") * 7919 % 500_000 - F.col("id") % 2).alias("ts"), hot.alias("url"))
    rows = rows.withColumn("ts", F.when(F.col("capture_id") % 500 != 7, F.col("ts")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sinks.write_index(rows, path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return path, [tuple(r) for r in rows.collect()]


def test_lookup_reads_few_files(spark, index):
    path, rows = index
    for prefix, wanted in (("org,h5)/", "https://h5.org/"), ("org,hot)/", "https://hot.org/"), ("org,h1", "https://h1"), ("zz", "none")):
        found = sinks.lookup(spark, path, prefix)
        assert sorted(r.capture_id for r in found.collect()) == sorted(i for i, _, u in rows if u.startswith(wanted))
        files, every = len(found.inputFiles()), len(spark.read.parquet(path).inputFiles())
        assert every == 8 and (files <= 3 if prefix == "org,h5)/" else True)


def test_nearest(spark, index):
    path, rows = index
    rng = random.Random(1)
    asked = [(i, rng.choice(["https://hot.org/", "https://h3.org/p3", "https://never.org/"]), rng.randrange(-9_000, 520_000)) for i in range(60)]
    asked += [(100, "https://hot.org/", int(next(t for i, t, u in rows if i == 9).timestamp()))]
    queries = spark.createDataFrame(asked, "n int, url string, s bigint").select("n", "url", F.timestamp_seconds("s").alias("ts"))
    found = {r.n: (r.nearest_id, r.nearest_ts) for r in sinks.nearest(spark.read.parquet(path), queries).collect()}
    assert len(found) == len(asked)
    for n, url, s in asked:
        around = [(abs(t.timestamp() - s), t, i) for i, t, u in rows if u == url and t is not None]
        assert found[n] == (min(around)[2], min(around)[1]) if around else found[n] == (None, None)


@pytest.mark.parametrize(("limit", "sizes"), [(100, range(0, 60)), (50, range(90, 200)), (10**9, range(1, 9)), (700, [0, 0, 0, 1, 5_000])])
def test_greedy_shards_equal_a_loop(spark, limit, sizes):
    rng = random.Random(limit)
    rows = [(i, rng.choice([None, rng.randrange(9_000)]), rng.choice([*sizes, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "capture_id bigint, s bigint, bytes bigint").select("capture_id", F.timestamp_seconds("s").alias("ts"), "bytes")
    want, shard, filled = {}, 0, 0
    for i, _, size in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])):
        if filled >= limit:
            shard, filled = shard + 1, 0
        want[i] = shard
        filled += size or 0
    found = sinks.rollover_greedy(df.repartition(4), limit)
    assert {r.capture_id: r.shard for r in found.collect()} == want
    assert found.columns == [*df.columns, "shard"]


def test_greedy_shards_of_nothing(spark):
    df = spark.createDataFrame([], "capture_id bigint, ts timestamp, bytes bigint, body string")
    assert sinks.rollover_greedy(df, 10).collect() == []


def test_compact_files(spark, tmp_path):
    many, few = str(tmp_path / "many"), str(tmp_path / "few")
    spark.range(400_000).select(F.col("id"), F.expr("uuid()").alias("x")).repartition(100).write.parquet(many)
    total = sum(map(os.path.getsize, glob.glob(many + "/*.parquet")))
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.minPartitionNum")
    before = [spark.conf.get(k, None) for k in keys]
    sinks.compact_files(spark, [many], few, total // 5, {"operator": "x"})
    assert [spark.conf.get(k, None) for k in keys] == before
    sizes = sorted(map(os.path.getsize, glob.glob(few + "/*.parquet")))
    assert all(abs(s - total // 5) <= total // 50 for s in sizes[1:]) and len(sizes) in (5, 6)
    back = spark.read.parquet(few)
    assert back.count() == 400_000 == back.select("id").distinct().count() and back.filter("operator = 'x'").count() == 400_000


# --- runs and filters --------------------------------------------------------


def test_names_of_runs_are_literal(spark, tmp_path):
    base = tmp_path / "collections" / "a"  # a root below a folder named collections
    for where, n in (("collections/crawl-[1]", 1), ("x/collections/mine", 2), ("collections/mine", 3), ("y/collections/crawl-9", 4), ("z/deep/collections/crawl-9", 5)):
        folder = base / where / "archive"
        spark.range(n).write.parquet(str(folder))
        os.utime(folder, (1_700_000_000 - n, 1_700_000_000 - n))
    count = lambda **k: {(r.run_no, r.collection): r["count"] for r in seeds.union_collections(spark, str(base), **k).groupBy("run_no", "collection").count().collect()}
    assert count(collection="crawl-[1]") == {(1, "crawl-[1]"): 1}
    assert count(collection="mine") == {(1, "mine"): 3}
    assert count() == {(1, "crawl-9"): 5, (2, "crawl-9"): 4, (3, "crawl-[1]"): 1}
    for name in ("*", "crawl-1", "crawl-9"):
        with pytest.raises(seeds.NoRunsError):
            seeds.union_collections(spark, str(base), name)


def test_exclusion_keeps_rows_without_url(spark):
    df = spark.createDataFrame([(1, "https://a/x"), (2, None), (3, "https://a/y")], "id int, url string")
    assert sorted(r.id for r in scope.exclude_rx(df, ["x$", "z"]).collect()) == [2, 3]
