import gzip
import io
import os
import tarfile
import time

import pytest
from pyspark.sql import functions as F

from strandline.sources import seeds as S
from strandline.sources import sinks, warc


# --- seeds, sitemap, logs, runs ---------------------------------------------


@pytest.mark.parametrize("text", ["http://h/1\nhttp://h/2\n", "a\r\nb\n\nc", "x", "\n\nq\n", "a\x0bb\nc d\n"])
def test_seed_file_lines(spark, tmp_path, text):
    path = tmp_path / "seeds.txt"
    path.write_bytes(text.encode())
    rows = S.load_seeds(spark, path=str(path)).collect()
    assert [r.url for r in sorted(rows)] == text.splitlines()
    assert sorted(r.pos for r in rows) == list(range(len(rows)))


def test_seed_file_read_in_splits(spark, tmp_path):
    path = tmp_path / "many.txt"
    lines = [f"http://h.org/{'p' * (i % 50)}/{i}" for i in range(5000)]
    path.write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        rows = S.load_seeds(spark, inline="first", path=str(path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.url for r in sorted(rows)] == ["first", *lines]


def test_inline_seeds(spark, tmp_path):
    rows = S.load_seeds(spark, "https://h:443/a, http://x/,http://y:bad/").collect()
    assert [tuple(r) for r in sorted(rows, key=lambda r: r.pos)] == [(0, "https://h/a"), (1, "http://x/"), (2, None)]
    empty = tmp_path / "empty.txt"
    empty.write_text("")
    for bad in ({}, {"inline": ""}, {"path": str(empty)}):
        with pytest.raises(S.NoSeedsError):
            S.load_seeds(spark, **bad)


def test_sitemap(spark, tmp_path):
    path = tmp_path / "sitemap.xml"
    path.write_text(
        '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
        "<url><loc> https://h:443/a </loc><lastmod>2024-05</lastmod></url><url><loc>https://h/b</loc></url></urlset>"
    )
    found = S.read_sitemap(spark, str(path))
    assert [tuple(r) for r in found.collect()] == [("https://h:443/a", "2024-05"), ("https://h/b", None)]
    seeds = S.load_seeds(spark, "https://h/a,https://h/c")
    assert sorted(r.url for r in S.with_sitemap(seeds, found).collect()) == ["https://h/a", "https://h/b", "https://h/c"]


def test_logs(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text(
        '{"ts":"2024-01-01T00:00:00Z","level":"info","context":"general","message":"m"}\n'
        '{"level":"warn","context":"jsError","message":"js"}\n{"level":"error","context":"links","message":"l"}\n'
    )
    logs = S.read_logs(spark, str(path))
    assert sorted(r.message for r in S.filter_logs(logs).collect()) == ["l", "m"]
    assert [r.message for r in S.filter_logs(logs, levels="warn, info").collect()] == ["m"]
    assert [r.message for r in S.filter_logs(logs, contexts=["jsError"], exclude=None).collect()] == ["js"]
    with pytest.raises(ValueError):
        S.filter_logs(logs, contexts="nonsense")
    assert len(S.LOG_CONTEXTS) == 28


def test_union_collections(spark, tmp_path):
    for n, name in enumerate(["crawl-b", "crawl-a", "named"]):
        folder = tmp_path / "collections" / name / "archive"
        spark.range(n + 1).withColumnRenamed("id", "capture_id").write.parquet(str(folder))
        for file in folder.iterdir():
            os.utime(file, (time.time() - 1000 + n, time.time() - 1000 + n))
    rows = S.union_collections(spark, str(tmp_path)).groupBy("run_no", "collection").count().collect()
    assert sorted(map(tuple, rows)) == [(1, "crawl-b", 1), (2, "crawl-a", 2)]
    assert S.union_collections(spark, str(tmp_path), "named").count() == 3
    with pytest.raises(S.NoRunsError):
        S.union_collections(spark, str(tmp_path / "nothing"))


def test_union_collections_of_warc_files(spark, tmp_path):
    warc.register(spark)
    for n, name in enumerate(["crawl-2", "crawl-1"]):
        folder = tmp_path / "collections" / name / "archive"
        folder.mkdir(parents=True)
        (folder / "x.warc").write_bytes(b"".join(RECORDS[: n + 2]))
        os.utime(folder / "x.warc", (1_700_000_000 + n, 1_700_000_000 + n))
    rows = S.union_collections(spark, str(tmp_path), format="warc").groupBy("run_no", "collection").count().collect()
    assert sorted(map(tuple, rows)) == [(1, "crawl-2", 2), (2, "crawl-1", 3)]


# --- WARC ---------------------------------------------------------------------


def record(kind, url, block, content_type="application/http; msgtype=response", extra=""):
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{kind}-{url}>\r\nWARC-Date: 2024-02-03T04:05:06Z\r\n"
    head += (f"WARC-Target-URI: {url}\r\n" if url else "") + extra
    return f"{head}Content-Type: {content_type}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


RECORDS = [
    record("warcinfo", None, b"software: x\r\n", "application/warc-fields"),
    record("request", "http://h/a", b"GET /a HTTP/1.1\r\nUser-Agent: Mozilla/5.0\r\n +Bot\r\nHost: h\r\n\r\n", "application/http; msgtype=request"),
    record("response", "http://h/a", b"HTTP/1.1 200 OK\r\nContent-Type: Text/HTML; charset=x\r\nSet-Cookie: a\r\nSet-Cookie: b\r\n\r\nWARC/1.0\r\n\x00\xffbody\r\n"),
    record("response", "http://h/b", b"HTTP/1.1 302 Found\r\nLocation: /c\r\n\r\n", extra="WARC-Payload-Digest: sha1:AB\r\n"),
    record("resource", "urn:text:x", b"plain", "text/plain"),
]


@pytest.fixture
def warc_files(tmp_path):
    (tmp_path / "a-1.0.warc").write_bytes(b"".join(RECORDS))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in RECORDS))
    for name, mode in (("c.tar", "w"), ("d.tar.gz", "w:gz")):
        with tarfile.open(tmp_path / name, mode) as tar:
            for inner in ("in/a-1.0.warc", "in/b.warc.gz", "in/notes.txt"):
                data = (tmp_path / os.path.basename(inner)).read_bytes() if "notes" not in inner else b"no"
                info = tarfile.TarInfo(inner)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
    return tmp_path


def test_warc_scan(spark, warc_files):
    warc.register(spark)
    paths = ", ".join(str(warc_files / n) for n in ("a-1.0.warc", "b.warc.gz", "c.tar", "d.tar.gz"))
    df = spark.read.format("warc").load(paths)
    assert df.groupBy("rec_type").count().filter("count <> case rec_type when 'response' then 12 else 6 end").count() == 0
    kinds = [tuple(r) for r in df.filter(F.col("file").endswith("b.warc.gz") & ~F.col("file").contains("!")).drop("file", "record_id", "ts").collect()]
    assert kinds[1][0:3] == ("request", "http://h/a", None) and kinds[1][7] == "Mozilla/5.0 +Bot"
    response = kinds[2]
    assert response[:4] == ("response", "http://h/a", 200, "text/html")
    assert response[8] == {"content-type": "Text/HTML; charset=x", "set-cookie": "a, b"}
    assert bytes(response[9]) == b"WARC/1.0\r\n\x00\xffbody\r\n"
    assert kinds[3][2] == 302 and kinds[3][5:7] == ("sha1:AB", "/c")
    assert kinds[4][3] == "text/plain" and bytes(kinds[4][9]) == b"plain"
    assert {str(r.ts) for r in df.select(F.col("ts").cast("string").alias("ts")).distinct().collect()} >= {"2024-02-03 04:05:06"}
    only = spark.read.format("warc").option("types", "request").option("body", "false").load(str(warc_files / "a-1.0.warc")).collect()
    assert [(r.rec_type, r.body) for r in only] == [("request", None)]


def test_warc_errors(spark, warc_files):
    warc.register(spark)
    for path, message in ((warc_files / "x.zip", "no archive"), (warc_files / "a-1.0.zip", "does not end in")):
        if "end in" in message:
            path.write_bytes(b"")
        with pytest.raises(Exception, match=message):
            spark.read.format("warc").load(str(path)).count()
    short = warc_files / "short.warc"
    short.write_bytes(RECORDS[2][:-20])
    with pytest.raises(Exception, match="cut short"):
        spark.read.format("warc").load(str(short)).count()


def test_warc_tasks_hold_their_share(tmp_path):
    for i, size in enumerate([900, 10, 10, 400, 700]):
        (tmp_path / f"{i}.warc").write_bytes(b"x" * size)
    reader = warc.WarcReader({"path": str(tmp_path), "taskBytes": "1000"})
    packed = [[os.path.getsize(p) for p in part.paths] for part in reader.partitions()]
    assert packed == [[900], [700], [400, 10, 10]]


def test_warc_round_trip(spark, tmp_path):
    warc.register(spark)
    out = str(tmp_path / "out")
    df = spark.range(200).select(
        F.lit("response").alias("rec_type"), F.concat(F.lit("http://h/"), "id").alias("url"), F.timestamp_seconds("id").alias("ts"),
        F.lit(200).alias("status"), F.lit("text/plain").alias("mime"), F.encode(F.repeat(F.lit("é"), F.col("id").cast("int")), "UTF-8").alias("body"),
    )
    df.repartition(3).write.format("warc").option("rolloverSize", 5000).option("info", "operator: x").mode("append").save(out)
    files = [f for f in os.listdir(out) if f.endswith(".warc.gz")]
    assert len(files) > 3 and sorted(os.listdir(out)) == sorted(files + [f + warc.OFFSETS for f in files])
    back = spark.read.format("warc").load(out)
    assert back.filter("rec_type = 'warcinfo'").count() == len(files)
    columns = ["url", "ts", "status", "mime", "body"]
    got = back.filter("rec_type = 'response'").select(columns)
    assert got.exceptAll(df.select(columns)).count() == 0 and got.count() == 200


def test_warc_keeps_what_rows_say(spark, tmp_path):
    """All kinds of record, without status or time, come back as they were."""
    warc.register(spark)
    rows = [
        ("response", "http://h/1", "2024-01-02 03:04:05", 404, "text/html", "x", None), ("response", "http://h/2", None, None, None, "", None),
        ("response", "http://h/3", "2024-01-02 03:04:05", 0, "text/plain", "z", None), ("resource", "urn:pageinfo:h", None, None, "text/plain", "HTTP/1.1 500 -", None),
        ("metadata", "http://h/4", "2024-01-02 03:04:05", None, "application/json", "{}", None), ("request", "http://h/a/b?c=1#d", None, None, None, "", None),
        ("revisit", "http://h/5", "2024-01-02 03:04:05", 200, "text/html", "", "http://h/1"),
    ]
    names = ["rec_type", "url", "ts", "status", "mime", "body", "refers_to_url"]
    df = spark.createDataFrame(rows, "rec_type string, url string, ts string, status int, mime string, body string, refers_to_url string")
    df = df.withColumns({"ts": F.col("ts").cast("timestamp"), "body": F.encode("body", "UTF-8")}).select(names)
    out = str(tmp_path / "out")
    df.write.format("warc").mode("append").save(out)
    back = spark.read.format("warc").load(out).filter("rec_type <> 'warcinfo'")
    assert back.select(names).exceptAll(df).count() == 0 and back.count() == len(rows)
    assert back.filter("capture_id is null").count() == 0
    raw = b"".join(gzip.open(os.path.join(out, f)).read() for f in os.listdir(out) if f.endswith(".gz"))
    assert b"GET /a/b?c=1 HTTP/1.1" in raw and raw.count(b"WARC-Date") == 4
    assert not [f for f in os.listdir(out) if f.endswith(".tmp")]


@pytest.mark.parametrize(
    "headers, body, want",
    [
        ({"transfer-encoding": "chunked"}, b"3\r\nabc\r\n2;x=y\r\nde\r\n0\r\n\r\n", b"abcde"),
        ({"transfer-encoding": "chunked"}, b"not chunked", b"not chunked"),
        ({"content-encoding": "gzip"}, gzip.compress(b"text"), b"text"),
        ({"content-encoding": "gzip"}, b"plain", b"plain"),
        ({"content-encoding": "br"}, b"coded", b"coded"),
        ({}, b"x", b"x"),
    ],
)
def test_decoded_bodies(headers, body, want):
    assert warc.decoded(body, headers) == want


# --- sinks --------------------------------------------------------------------


def test_archive_refuses_and_overwrites(spark, tmp_path):
    path = str(tmp_path / "archive")
    df = spark.range(500).select(F.concat(F.lit("http://h"), F.when(F.col("id") < 200, 0).otherwise(F.col("id")), F.lit("/"), "id").alias("url"))
    sinks.check_target(spark, path)
    sinks.write_archive(df, path, buckets=4, made_by=["crawler 1.2"])
    for attempt in (lambda: sinks.write_archive(df, path), lambda: sinks.check_target(spark, path)):
        with pytest.raises(sinks.ArchiveExists) as error:
            attempt()
        assert error.value.exit_code == 2
    assert spark.read.parquet(path).count() == 500
    sinks.write_archive(df.limit(10), path, overwrite=True, buckets=4)
    back = spark.read.parquet(path)
    assert back.count() == 10
    assert back.first().provenance.startswith("strandline ")


def test_index_is_sorted(spark, tmp_path):
    df = spark.range(300).select(
        F.col("id").alias("capture_id"), F.timestamp_seconds(F.col("id") * 7 % 50).alias("ts"),
        F.concat(F.lit("http://www.h"), F.col("id") % 3, F.lit(".org/"), F.col("id") % 11).alias("url"), F.lit(200).alias("status"),
    )
    path = str(tmp_path / "index")
    sinks.build_index(df).write.parquet(path)
    files = spark.read.parquet(path).select("*", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n")).orderBy("f", "n").collect()
    keys = [(r.key, r.ts, r.capture_id) for r in files]
    assert keys == sorted(keys) and len(keys) == 300
    assert keys[0][0] == "org,h0,www)/0"


def test_rollover_and_compact(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("capture_id"), F.timestamp_seconds("id").alias("ts"), F.lit(30).cast("bigint").alias("bytes"))
    shards = {r.capture_id: r.shard for r in sinks.rollover(df, 100).collect()}
    assert shards == {i: i * 30 // 100 for i in range(100)}
    path = str(tmp_path / "few")
    sinks.compact(df.repartition(20), 3, info={"operator": "x"}).write.parquet(path)
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) == 3
    assert spark.read.parquet(path).filter("operator = 'x'").count() == 100


def test_page_text(spark, tmp_path):
    html = "<html><head><title>T</title><style>p{}</style></head><body><!-- <p>no</p> --><p>Fish &amp;amp; chips&nbsp;&lt;b&gt;\n<script>x='</p>'</script>now</p></body>"
    pages = spark.createDataFrame([("http://h/", html)], "url string, html string")
    assert sinks.page_text(pages).first().text == "T Fish &amp; chips <b> now"
    path = str(tmp_path / "pages")
    sinks.write_page_list(pages, path)
    assert spark.read.json(path).first().url == "http://h/"
    with pytest.raises(sinks.ArchiveExists):
        sinks.write_page_list(pages, path)


def test_union_collections_at_mixed_depths(spark, tmp_path):
    for n, place in enumerate(("", "a/", "a/b/c/", "d/e/f/g/")):
        spark.range(n + 1).write.parquet(str(tmp_path / f"{place}collections/crawl-{n}/archive"))
    spark.range(9).write.parquet(str(tmp_path / "collections/other/archive"))
    rows = S.union_collections(spark, str(tmp_path)).groupBy("collection").count().collect()
    assert sorted(map(tuple, rows)) == [(f"crawl-{n}", n + 1) for n in range(4)]


def test_decoded_bodies_of_several_members():
    two = gzip.compress(b"first ") + gzip.compress(b"second")
    assert warc.decoded(two, {"content-encoding": "gzip"}) == b"first second"
    assert warc.decoded(two + b"\0\0", {"content-encoding": "x-gzip"}) == b"first second"
    assert warc.decoded(two + b"no member", {"content-encoding": "gzip"}) == b"first second"
    assert warc.decoded(two[:-12], {"content-encoding": "gzip"}).startswith(b"first ")
