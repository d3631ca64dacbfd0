"""One query per operator, over the given tables.  Names start with the
operator's id in the survey."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import fixtures
from strandline.functions import urls as U
from strandline.operators import canonical, graph, quality, rank, report, scope
from strandline.plans.archive_build import Recipe, build_archive
from strandline.plans.archive_report import host_report
from strandline.session import scratch, written
from strandline.sources import seeds as sources
from strandline.sources import sinks, states, warc
from strandline.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

EXCLUDE = (r"\?utm_", r"/96[0-9]")
BLOCK = (scope.BlockRule(r"//blog\."), scope.BlockRule(r"/fr/", r"(?i)nicht"))
SIZE_LIMIT = 5_000_000
TIME_LIMIT = 300_000
PREFIX = "net,example,"


def query(name: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return fixtures.derived(spark, sf_dir, name) if name in fixtures.SQL else fixtures.given(spark, sf_dir, name)


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.with_failed(table(spark, sf_dir, "captures"), invalid_status_fails=True)


@query("host_report")
def _(spark, d):
    return host_report(table(spark, d, "captures"), table(spark, d, "blocklist"), EXCLUDE)


@query("archive_build")
def _(spark, d):
    recipe = Recipe(
        output=scratch(spark, "built"), scope_type="host", exclude=EXCLUDE, page_limit=100, size_soft_limit=SIZE_LIMIT // 10, buckets=8
    )
    pages = table(spark, d, "pages").select("page_id", F.col("html").alias("body"))
    captures = table(spark, d, "captures").select("capture_id", "page_id", "ts", "url", "status", "bytes", "digest").join(pages, "page_id")
    captures = written(captures, "captures")  # with bodies, as a crawl leaves them
    built = build_archive(captures, table(spark, d, "seeds"), recipe, table(spark, d, "blocklist"))
    kept = spark.read.parquet(recipe.output).select("capture_id", "url", "bytes")
    return kept.withColumn("partial", F.lit(built.partial))


def _url_edges(spark, d) -> DataFrame:
    pages = table(spark, d, "pages")
    links = table(spark, d, "edges").select(F.col("src").alias("page_id"), "dst").join(pages.select("page_id", F.col("url").alias("src")), "page_id")
    return links.join(pages.select(F.col("page_id").alias("dst"), F.col("url").alias("to")), "dst").select("src", F.col("to").alias("dst"))


@query("archive_build_full")
def _(spark, d):
    recipe = Recipe(
        output=scratch(spark, "built"), scope_type="host", exclude=EXCLUDE, depth=3, sitemap_from="2021", sitemap_to="2022-12-31",
        max_retries=1, invalid_status_fails=True, size_soft_limit=SIZE_LIMIT, buckets=8, rollover_size=SIZE_LIMIT // 50,
    )
    captures = table(spark, d, "captures").select("capture_id", "ts", "status", "bytes", "digest", "attempt")
    captures = captures.join(table(spark, d, "variants"), "capture_id").withColumn("redirect_to", F.lit(None).cast("string"))
    captures = written(captures.unionByName(table(spark, d, "hops")), "captures")
    built = build_archive(captures, table(spark, d, "seeds"), recipe, table(spark, d, "blocklist"), _url_edges(spark, d), table(spark, d, "sitemap"))
    kept = spark.read.parquet(recipe.output).select("capture_id", "url", "bytes")
    return kept.crossJoin(F.broadcast(built.progress.select("done", "total", "partial")))


# --- sources and sinks ------------------------------------------------------


@query("S1_load_seeds")
def _(spark, d):
    path = scratch(spark, "seeds")
    pages = table(spark, d, "pages").select("page_id", "url")
    pages.repartitionByRange("page_id").sortWithinPartitions("page_id").select("url").write.text(path)
    return sources.load_seeds(spark, path=path)


@query("S2_warc_scan")
def _(spark, d):
    warc.register(spark)
    path = scratch(spark, "warc")
    pages = table(spark, d, "pages").select(
        F.lit("response").alias("rec_type"), "url", F.lit(200).alias("status"), F.lit("text/html").alias("mime"),
        F.encode("html", "UTF-8").alias("body"),
    )
    pages.write.format("warc").mode("append").save(path)
    found = spark.read.format("warc").option("types", "response").load(path)
    return found.select("url", "status", "mime", F.octet_length("body").alias("size"), F.md5("body").alias("digest"))


def _scanned(spark, d) -> DataFrame:
    """All captures written to WARC files and read back."""
    warc.register(spark)
    path = scratch(spark, "warc")
    rows = table(spark, d, "captures").select(
        "rec_type", "url", "ts", "status", "digest", "user_agent", F.concat(F.lit("capture "), "capture_id").alias("record_id")
    )
    rows.withColumn("ts", F.col("ts").cast("timestamp")).write.format("warc").mode("append").save(path)
    return spark.read.format("warc").option("types", "request,response").load(path)


@query("S2_warc_to_ua_audit")
def _(spark, d):
    hosts = _scanned(spark, d).withColumn("host", U.host("url"))
    return report.ua_audit(hosts, report.user_agent_suffix("+Bot", "test@example.com"), ["host"])


@query("S2_warc_to_dedup")
def _(spark, d):
    return rank.dedup(_scanned(spark, d).select("capture_id", "url", "digest", "ts")).drop("ts")


@query("S3_union_collections")
def _(spark, d):
    root = scratch(spark, "runs")
    captures = table(spark, d, "captures").select("capture_id", "collection", "ts", "url", "bytes")
    for name in ("crawl-2", "crawl-0", "crawl-1"):  # the order of change
        captures.filter(F.col("collection") == name).drop("collection").write.parquet(f"{root}/collections/{name}/archive")
    runs = sources.union_collections(spark, root)
    return runs.groupBy("run_no", "collection").agg(F.count("*").alias("captures"), F.sum("bytes").alias("bytes"))


@query("S4_read_sitemap")
def _(spark, d):
    path = scratch(spark, "sitemap")
    table(spark, d, "sitemap").write.option("rootTag", "urlset").option("rowTag", "url").xml(path)
    return sources.read_sitemap(spark, path)


@query("S4_sitemap_seeds")
def _(spark, d):
    return sources.with_sitemap(table(spark, d, "seeds"), table(spark, d, "sitemap"))


@query("S5_filter_logs")
def _(spark, d):
    path = scratch(spark, "logs")
    logs = table(spark, d, "logs").withColumn("message", F.col("log_id").cast("string")).drop("log_id")
    logs.withColumn("ts", F.col("ts").cast("timestamp")).write.json(path)
    kept = sources.filter_logs(sources.read_logs(spark, path), levels="error,warn")
    return kept.select(F.col("message").cast("bigint").alias("log_id"), "level", "context")


@query("S6_write_archive")
def _(spark, d):
    path = scratch(spark, "archive")
    captures = table(spark, d, "captures").select("capture_id", "url", "status", "bytes", "digest")
    sinks.write_archive(captures, path, buckets=8)
    sinks.write_archive(captures, path, overwrite=True, buckets=8)
    return spark.read.parquet(path).drop("host_bucket", "provenance")


@query("S7_build_index")
def _(spark, d):
    return sinks.build_index(table(spark, d, "captures")).drop("ts")


@query("S8_rollover")
def _(spark, d):
    thin = table(spark, d, "captures").select("capture_id", "ts", "bytes")
    return sinks.rollover(thin, 1_000_000).select("capture_id", "shard")


@query("S7_lookup")
def _(spark, d):
    path = scratch(spark, "index")
    sinks.write_index(table(spark, d, "captures"), path)
    return sinks.lookup(spark, path, PREFIX).drop("ts")


@query("S7_nearest")
def _(spark, d):
    path = scratch(spark, "index")
    sinks.write_index(table(spark, d, "captures"), path)
    found = sinks.nearest(spark.read.parquet(path), table(spark, d, "asked"))
    return found.select("page_id", "url", "nearest_id", F.unix_seconds("nearest_ts").alias("nearest"))


@query("S8_rollover_greedy")
def _(spark, d):
    thin = table(spark, d, "captures").select("capture_id", "ts", "bytes")
    return sinks.rollover_greedy(thin, 1_000_000).select("capture_id", "shard")


@query("S9_compact_files")
def _(spark, d):
    many, few = scratch(spark, "many"), scratch(spark, "few")
    table(spark, d, "captures").select("capture_id", "collection", "bytes").repartition(40, "capture_id").write.parquet(many)
    sinks.compact_files(spark, [many], few, 1 << 20, {"operator": "nightly"})
    return spark.read.parquet(few).drop("provenance")


@query("S9_compact")
def _(spark, d):
    thin = table(spark, d, "captures").select("capture_id", "ts", "collection", "bytes")
    return sinks.compact(thin, 4, info={"operator": "nightly"}).select("capture_id", "collection", "bytes", "operator")


@query("S10_page_text")
def _(spark, d):
    return sinks.page_text(table(spark, d, "pages"))


@query("S10_page_text_hostile")
def _(spark, d):
    return sinks.page_text(table(spark, d, "odd_pages"))


@query("G1_extract_links_hostile")
def _(spark, d):
    return graph.extract_links(table(spark, d, "odd_pages"), ("a[href]->href", "area.nav[shape=rect]->href"))


@query("G1_extract_links_nested")
def _(spark, d):
    rules = ("nav > ul > li a[href]->href", "h2 + p a, h2 ~ p.x > a -> href", "tr + tr > th > a->href")
    return graph.extract_links(table(spark, d, "nested_pages"), rules)


# --- URL projections --------------------------------------------------------


@query("U1_clean_url")
def _(spark, d):
    return table(spark, d, "spelled").select("page_id", U.clean_url("url").alias("clean"))


@query("U1_collisions")
def _(spark, d):
    return canonical.collisions(table(spark, d, "variants"))


@query("U2_strip_fragment")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", U.strip_fragment("url").alias("url"))


@query("U3_override_origin")
def _(spark, d):
    return canonical.override_origin(table(spark, d, "pages").select("page_id", "url"), table(spark, d, "mapping"))


@query("U4_entry_path")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", U.entry_path("url").alias("path"))


# --- filters ----------------------------------------------------------------


def _scoped(kind, change=None):
    def run(spark, d):
        seeds = table(spark, d, "seeds")
        if change is not None:
            seeds = seeds.withColumn("url", change())
        return scope.in_scope(table(spark, d, "pages").select("page_id", "url"), seeds, kind)

    return run


def _site_root():
    return F.concat(F.lit("https://"), F.regexp_replace(U.host("url"), r"^(www|m|blog)\.", ""), F.lit("/"))


QUERIES["F1_scope_page"] = _scoped("page")
QUERIES["F1_scope_page_spa"] = _scoped("page-spa", lambda: F.concat(U.strip_fragment("url"), F.lit("#view")))
QUERIES["F1_scope_prefix"] = _scoped(None)
QUERIES["F1_scope_host"] = _scoped("host")
QUERIES["F1_scope_domain"] = _scoped("domain", _site_root)
QUERIES["F1_scope_any"] = _scoped("any")


@query("F1_scope_custom")
def _(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    return scope.in_scope(pages, table(spark, d, "seeds"), include=r"\.html$")


@query("F2_include_rx")
def _(spark, d):
    return scope.include_rx(table(spark, d, "pages").select("page_id", "url"), r"/(en|fr)/[0-9]+\.html")


@query("F3_exclude_rx")
def _(spark, d):
    return scope.exclude_rx(table(spark, d, "pages").select("page_id", "url"), EXCLUDE)


@query("F4_block")
def _(spark, d):
    return scope.block(table(spark, d, "pages"), BLOCK, text="html").select("page_id", "url")


@query("F4_block_message")
def _(spark, d):
    pages = table(spark, d, "pages").withColumn("digest", F.md5("html"))
    return scope.block(pages, BLOCK, "blocked by rule", text="html").select("page_id", "digest", "blocked")


@query("F4_block_table")
def _(spark, d):
    pages = table(spark, d, "pages").withColumn("digest", F.md5("html"))
    return scope.block_table(pages, table(spark, d, "block_rules"), "blocked by rule", text="html").select("page_id", "digest", "blocked")


@query("F5_block_hosts")
def _(spark, d):
    captures = table(spark, d, "captures").select("capture_id", "url")
    return scope.block_hosts(captures, table(spark, d, "blocklist"))


@query("F5_block_hosts_message")
def _(spark, d):
    captures = table(spark, d, "captures").select("capture_id", "url", "bytes")
    return scope.block_hosts(captures, table(spark, d, "blocklist"), "an ad was here").drop("url")


@query("F6_sitemap_between")
def _(spark, d):
    return scope.sitemap_between(table(spark, d, "sitemap"), "2021-03", "2023-03-14")


@query("F7_page_limit")
def _(spark, d):
    thin = table(spark, d, "captures").select("capture_id", "ts", "url")
    return scope.page_limit(thin, limit=50, max_limit=500).drop("ts")


@query("F7_page_limit_nulls")
def _(spark, d):
    thin = table(spark, d, "timeless").select("capture_id", "ts", "collection")
    return scope.page_limit(thin, limit=120, per=["collection"], top_k=0).select("capture_id", "collection")


@query("F8_size_nulls")
def _(spark, d):
    return scope.limit_cut(table(spark, d, "timeless").select("capture_id", "ts", "bytes"), SIZE_LIMIT).df.select("capture_id", "bytes")


@query("F7_page_limit_large")
def _(spark, d):
    thin = table(spark, d, "captures").select("capture_id", "ts", "url")
    return scope.page_limit(thin, limit=700, top_k=0).drop("ts")


@query("F7_page_limit_per_collection")
def _(spark, d):
    thin = table(spark, d, "captures").select("capture_id", "ts", "collection")
    return scope.page_limit(thin, limit=100, per=["collection"]).drop("ts")


@query("F7_page_limit_per_collection_large")
def _(spark, d):
    thin = table(spark, d, "captures").select("capture_id", "ts", "collection")
    return scope.page_limit(thin, limit=250, per=["collection"], top_k=0).drop("ts")


def _cut(limit, by, mode):
    def run(spark, d):
        cut = scope.limit_cut(table(spark, d, "captures").select("capture_id", "ts", "bytes"), limit, by, mode)
        return cut.df.select("capture_id", "bytes", F.lit(cut.partial).alias("partial"))

    return run


QUERIES["F8_size_soft"] = _cut(SIZE_LIMIT, "bytes", "soft")
QUERIES["F8_size_hard"] = _cut(SIZE_LIMIT, "bytes", "hard")
QUERIES["F8_size_not_hit"] = _cut(10**15, "bytes", "hard")
QUERIES["F8_time_soft"] = _cut(TIME_LIMIT, "elapsed", "soft")
QUERIES["F8_time_hard"] = _cut(TIME_LIMIT, "elapsed", "hard")


@query("F9_with_failed")
def _(spark, d):
    both = judged(spark, d).withColumnRenamed("failed", "failed_strict")
    return scope.with_failed(both).select("capture_id", "failed", "failed_strict")


# --- graph ------------------------------------------------------------------


@query("G1_extract_links")
def _(spark, d):
    return graph.extract_links(table(spark, d, "pages"))


def _reached(spark, d, edges, **options):
    seeds = table(spark, d, "seeds").select(F.col("pos").alias("url"))
    return graph.reach(seeds, table(spark, d, edges), **options).withColumnRenamed("url", "page_id")


@query("G2_reach_depth")
def _(spark, d):
    return _reached(spark, d, "edges", depth=2).drop("extra")


@query("G2_reach_all")
def _(spark, d):
    return _reached(spark, d, "edges").drop("extra")


@query("G2_reach_redirected")
def _(spark, d):
    moves = graph.redirect_map(table(spark, d, "hops"))
    return graph.reach_redirected(table(spark, d, "seeds"), _url_edges(spark, d), moves, depth=4).drop("extra")


@query("G3_extra_hops")
def _(spark, d):
    return _reached(spark, d, "scoped_edges", depth=6, extra_hops=2)


@query("G4_resolve_redirects")
def _(spark, d):
    return graph.resolve_redirects(table(spark, d, "redirects"))


@query("G5_frontier")
def _(spark, d):
    pages = table(spark, d, "pages")
    known = graph.extract_links(pages).select(F.col("dst").alias("url")).unionByName(pages.select("url"))
    return graph.frontier(known, table(spark, d, "captures"))


@query("G5_saved_deltas")
def _(spark, d):
    """A frontier saved at first and after each collection, as what changed."""
    pages, root = table(spark, d, "pages"), scratch(spark, "chains")
    links = graph.extract_links(pages).select(F.col("dst").alias("url")).unionByName(pages.select("url"))
    pending = written(links.distinct(), "pending")
    captures = table(spark, d, "captures")
    states.save_delta(pending, root, "crawl")
    for done in ("crawl-0", "crawl-1", "crawl-2"):
        pending = graph.frontier(states.load_chain(spark, root, "crawl"), captures.filter(F.col("collection") == done))
        states.save_delta(pending, root, "crawl")
    return states.load_chain(spark, root, "crawl")


# --- deduplication and ranking ----------------------------------------------


def _thin(spark, d):
    return table(spark, d, "captures").select("capture_id", "ts", "url", "digest")


@query("D1_dedup_skip")
def _(spark, d):
    return rank.dedup(_thin(spark, d)).drop("ts")


@query("D1_dedup_skip_digest")
def _(spark, d):
    return rank.dedup(_thin(spark, d), key=("digest",)).drop("ts")


@query("D1_dedup_revisit")
def _(spark, d):
    return rank.dedup(_thin(spark, d), "revisit").select("capture_id", "revisit_of")


@query("D1_dedup_keep")
def _(spark, d):
    return rank.dedup(_thin(spark, d), "keep").drop("ts")


@query("D2_final_attempt")
def _(spark, d):
    thin = judged(spark, d).select("capture_id", "url", "attempt", "status", "failed")
    return rank.final_attempt(thin)


@query("D3_retain_latest")
def _(spark, d):
    return rank.retain_latest(table(spark, d, "states")).select("crawl_id", "state_id")


@query("G4_redirect_map_resolved")
def _(spark, d):
    return graph.resolve_redirects(graph.redirect_map(table(spark, d, "moved")))


@query("D4_homepage")
def _(spark, d):
    return rank.homepage(table(spark, d, "site_seeds"), table(spark, d, "url_redirects"))


# --- reports ----------------------------------------------------------------


def _stats(spark, d, by):
    pages = judged(spark, d).withColumn("pending", F.col("user_agent").startswith("curl"))
    stats = report.crawl_stats(pages, by, page_limit=2000)
    return stats.select("*", F.col("limit.max").alias("limit_max"), F.col("limit.hit").alias("limit_hit")).drop("limit")


@query("A1_crawl_stats")
def _(spark, d):
    return _stats(spark, d, ())


@query("A1_crawl_stats_by_collection")
def _(spark, d):
    return _stats(spark, d, ("collection",))


@query("A2_failed_seeds")
def _(spark, d):
    pages = rank.final_attempt(judged(spark, d).select("capture_id", "url", "attempt", "failed"), max_retries=1)
    return report.failed_seeds(table(spark, d, "site_seeds"), pages)


@query("A3_failed_limit")
def _(spark, d):
    return report.failed_limit(judged(spark, d), 1200, ["collection"])


@query("A4_classify_runs")
def _(spark, d):
    runs = report.classify_runs(table(spark, d, "runs"))
    return runs.select("run_id", "outcome", "converts", "final_code", "partial_flag")


@query("A4_outcome_counts")
def _(spark, d):
    return report.outcome_counts(table(spark, d, "runs"))


@query("A5_progress")
def _(spark, d):
    updates = (table(spark, d, t) for t in ("crawl_updates", "convert_updates"))
    return report.progress(*updates, by=["collection"])


@query("A6_ua_audit")
def _(spark, d):
    suffix = report.user_agent_suffix("+Bot", "test@example.com")
    return report.ua_audit(table(spark, d, "captures"), suffix)


@query("A6_ua_audit_by_host")
def _(spark, d):
    suffix = report.user_agent_suffix("+Bot", "test@example.com")
    return report.ua_audit(table(spark, d, "captures"), suffix, ["host"])


@query("A7_charset_audit")
def _(spark, d):
    html = F.encode("html", "UTF-8")
    body = F.when(F.col("damaged"), F.concat(html, F.unhex(F.lit("FF")))).otherwise(html)
    return report.charset_audit(table(spark, d, "typed").withColumn("body", body), aliases={"utf8": "utf-8"})


@query("A8_site_metadata")
def _(spark, d):
    tables = (table(spark, d, t) for t in ("pages", "site_seeds", "overrides"))
    return report.site_metadata(*tables)


# --- quality ----------------------------------------------------------------


@query("Q1_missing_entries")
def _(spark, d):
    expected = table(spark, d, "expected").select(F.concat_ws("/", "host", "expected_page").alias("path"))
    entries = table(spark, d, "captures").select(F.concat_ws("/", "host", "page_id").alias("path"), "bytes")
    return quality.missing_entries(expected, entries)


@query("Q2_check_recipes")
def _(spark, d):
    return quality.check_recipes(table(spark, d, "recipes"), quality.recipe_rules("arc"))


@query("Q3_qa_compare_spellings")
def _(spark, d):
    pages, texts = table(spark, d, "pages"), sinks.page_text(table(spark, d, "odd_pages"))
    spelled = pages.select(F.concat(F.lit("HTTPS"), F.regexp_replace("url", "^[a-z]+", "")).alias("url"), "html")
    both = spelled.unionByName(pages.select(F.regexp_replace("url", "^[a-z]+", "https").alias("url"), F.reverse("html").alias("html")))
    crawl = both.select("url", F.col("html").alias("text"))
    return quality.qa_compare(crawl, texts.select(F.regexp_replace("url", "^[a-z]+", "https").alias("url"), "text"))


@query("Q3_qa_compare")
def _(spark, d):
    sides = [table(spark, d, t) for t in ("documents", "replay")]
    url = F.concat(F.lit("https://docs.example.org/"), F.col("doc_id").cast("string")).alias("url")
    return quality.qa_compare(*[s.select(url, "text") for s in sides])


# --- streams ----------------------------------------------------------------


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of captures, time-zoned as watermarks need it."""
    schema = fixtures.given(spark, sf_dir, "events").schema
    return as_captures(spark.readStream.schema(schema).option("pathGlobFilter", "events*").parquet(sf_dir))


def as_captures(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("capture_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("crawl-"), F.col("event_id") % 3).alias("collection"),
        F.concat(F.lit("https://u.example.org/"), F.col("user_id"), F.lit("/"), F.col("event_type")).alias("url"),
        F.round(F.col("value") * 100).cast("bigint").alias("bytes"),
        F.col("event_type").isin("error", "signup").alias("failed"),
    )


@query("T1_progress_stream")
def _(spark, d):
    parts = []
    for name, schema in (("crawl_updates", live.CRAWL_UPDATES), ("convert_updates", live.CONVERT_UPDATES)):
        path = scratch(spark, name)
        table(spark, d, name).withColumn("ts", F.col("ts").cast("timestamp")).write.json(path)
        parts.append(live.read_updates(spark, path, "collection string, " + schema))
    name = "progress_" + uuid4().hex
    latest = live.progress_stream(*parts, by=["collection"])
    stream = latest.writeStream.format("memory").queryName(name).outputMode("complete")
    stream.trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@query("T2_crawl_stats_stream")
def _(spark, d):
    stats = live.crawl_stats_stream(event_stream(spark, d), "1 hour", "10 minutes", by=["collection"])
    done = live.run_to_table(stats, "stats")
    return done.select(F.unix_seconds("start").alias("start"), "collection", "crawled", "failed", "total")


@query("T3_dedup_stream")
def _(spark, d):
    firsts = live.firsts_per_window(event_stream(spark, d), ["url"], "10 minutes")
    stored = spark.readStream.schema(firsts.schema).parquet(live.run(firsts, "firsts"))
    return live.run_to_table(live.first_of_key(stored, ["url"]), "first").select("url", "capture_id")


@query("T3_first_merged")
def _(spark, d):
    """Captures that come in four batches, not in the order of their times."""
    path = scratch(spark, "captured")
    as_captures(table(spark, d, "events")).repartition(4, "capture_id").write.parquet(path)
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    firsts = live.FirstCaptures(spark, schema, ["url"], scratch(spark, "firsts"), buckets=8)
    return firsts.run(stream).select("url", "capture_id")


@query("T4_limit_monitor")
def _(spark, d):
    sums = live.bytes_per_window(event_stream(spark, d), "10 minutes")
    stored = spark.readStream.schema(sums.schema).parquet(live.run(sums, "sums"))
    alerts = live.run_to_table(live.limit_monitor(stored, 500_000), "alerts")
    return alerts.select("collection", F.unix_seconds("end").alias("end"), "bytes")
