"""From captures to a finished archive, in one job.

Everything is decided on a thin table of ids, URLs, times and sizes.  Bodies are
read where a text rule needs them and once more at the end, when the captures kept
are written.  Captures read from Parquet files are picked there by bitmaps of their
places in the files, so the only exchange that carries bodies is that of the writer;
others are joined on their id."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import urls as U
from strandline.operators import canonical, graph, positions, rank, report, scope
from strandline.operators.canonical import once
from strandline.operators.skew import lookup_join
from strandline.session import written
from strandline.sources import sinks


@dataclass
class Recipe:
    """What a crawl job asks for.  Limits of 0 or None are off."""

    output: str
    scope_type: str | None = None
    include: str | None = None
    exclude: Sequence[str] = ()
    allow_hash: bool = False
    block_rules: Sequence[scope.BlockRule] = ()
    block_message: str | None = None
    ad_message: str | None = None
    dedup_policy: str = "skip"
    page_limit: int = 0
    max_page_limit: int = 0
    size_soft_limit: int | None = None
    size_hard_limit: int | None = None
    time_soft_limit: int | None = None
    time_hard_limit: int | None = None
    depth: int = -1  # with links: how far from the seeds
    extra_hops: int = 0
    sitemap_from: str | None = None
    sitemap_to: str | None = None
    max_retries: int | None = None  # with an ``attempt`` column: one attempt a page stays
    invalid_status_fails: bool = False
    fail_on_failed_seed: bool = False
    fail_on_failed_limit: int = 0
    overwrite: bool = False
    buckets: int = 64
    made_by: Sequence[str] = field(default_factory=tuple)
    text: bool = False  # with ``html``: a list of pages with their text
    rollover_size: int = 0  # with a size: a table of shards, cut as files would be
    user_agent_suffix: str | None = None  # with ``user_agent``: requests are audited


@dataclass
class Built:
    exit_code: int
    outcome: str
    partial: bool
    stats: dict[str, Any] | None = None
    progress: DataFrame | None = None  # done, total, partial
    metadata: DataFrame | None = None  # one row per site
    bad_urls: int = 0  # captures left out because their URL cannot be used
    user_agents: DataFrame | None = None  # the audit, if asked for


FAILED_PAGES = 1  # fixed value: the exit code when seeds or pages fail
THIN = ("capture_id", "ts", "url", "status", "bytes", "digest", "attempt", "rule_blocked", "host_blocked", positions.FILE, positions.AT)


def candidates(
    captures: DataFrame,
    seeds: DataFrame,
    recipe: Recipe,
    hosts: DataFrame | None = None,
    mapping: DataFrame | None = None,
    hopping: bool = False,
) -> DataFrame:
    """The captures whose URL and text a recipe allows: cheap tests of the URL
    alone come first, then joins.  URLs are cleaned (``raw_url`` keeps the spelling),
    those that cannot be used go.  ``hopping``: links decide what is out of scope."""
    kept = scope.exclude_rx(captures.withColumn("raw_url", F.col("url")), recipe.exclude)
    kept = once(kept, url=U.clean_url("url"))
    if mapping is not None:
        kept = canonical.override_origin(kept, mapping)
    kept = kept.withColumn("url", U.strip_fragment("url", recipe.allow_hash))
    if not hopping:
        kept = scope.in_scope(kept, seeds, recipe.scope_type, recipe.include)
    if recipe.block_rules:
        kept = scope.block(kept, recipe.block_rules, recipe.block_message)
        kept = kept.withColumnRenamed("blocked", "rule_blocked")
    if hosts is not None:
        kept = scope.block_hosts(kept, hosts, recipe.ad_message)
        kept = kept.withColumnRenamed("blocked", "host_blocked")
    return kept


def picked(captures: DataFrame, kept: DataFrame, recipe: Recipe, mapping: DataFrame | None = None) -> Iterator[DataFrame]:
    """The captures that stay, read by their places in the files (``captures`` is
    located): their URLs are cleaned once more, and messages take the place of what is
    blocked.  No row is shuffled.  In parts, one per group of files."""
    flags = {c: F.col(c) for c in ("rule_blocked", "host_blocked") if c in kept.columns}
    marks = written(positions.bitmaps(kept, kept_here=F.lit(True), **flags), "positions")
    for part in positions.selected(captures.withColumn("raw_url", F.col("url")), marks, "kept_here"):
        part = part.withColumn("url", U.clean_url("url"))
        if mapping is not None:
            part = canonical.override_origin(part, mapping)
        part = part.withColumn("url", U.strip_fragment("url", recipe.allow_hash))
        for flag, message in (("rule_blocked", recipe.block_message), ("host_blocked", recipe.ad_message)):
            if flag in flags:
                part = scope.replace_blocked(part, F.col(flag), message).drop("blocked", flag)
        yield part


def _address(url: str, recipe: Recipe) -> Column:
    """A URL as captures have it in the job."""
    return U.strip_fragment(U.clean_url(url), recipe.allow_hash)


def decide(
    allowed: DataFrame, seeds: DataFrame, recipe: Recipe, links: DataFrame | None = None, redirects: DataFrame | None = None
) -> DataFrame:
    """Which candidates stay, before size and time limits, as a thin stored table
    (with ``revisit_of`` if the policy is revisit).  Redirects (src, dst) are followed
    on the way from the seeds and are no hops."""
    thin = allowed.select(*[c for c in THIN if c in allowed.columns])
    if links is not None or (recipe.max_retries is not None and "attempt" in thin.columns):
        thin = written(thin, "allowed")  # read several times: URLs are cleaned and tested once
    if links is not None:
        seeds = seeds.withColumn("url", _address("url", recipe))
        links = links.select(*[_address(c, recipe).alias(c) for c in ("src", "dst")])
        marked = scope.flag_scope(links, seeds, recipe.scope_type, recipe.include)
        if redirects is None:
            reached = graph.reach(seeds, marked, recipe.depth, recipe.extra_hops)
        else:
            reached = graph.reach_redirected(seeds, marked, redirects, recipe.depth, recipe.extra_hops)
        reached = reached.select("url").distinct()
        thin = lookup_join(thin, reached, ["url"], "left_semi", spread=["capture_id"], measure=False)
    if recipe.max_retries is not None and "attempt" in thin.columns:
        tried = scope.with_failed(thin, recipe.invalid_status_fails)
        thin = rank.final_attempt(tried, recipe.max_retries).select(*thin.columns)
    kept = written(rank.dedup(thin, recipe.dedup_policy), "kept")
    if recipe.page_limit or recipe.max_page_limit:
        firsts = rank.dedup(kept.select("url", "ts", "capture_id"), "skip", key=("url",))
        pages = scope.page_limit(firsts, recipe.page_limit, recipe.max_page_limit)
        kept = lookup_join(kept, written(pages.select("url"), "pages"), ["url"], "left_semi", spread=["capture_id"])
    return kept


def bodies(allowed: DataFrame, kept: DataFrame) -> DataFrame:
    """The candidates that stay, with all their columns."""
    more = [c for c in kept.columns if c == "revisit_of"]
    return lookup_join(allowed, kept.select("capture_id", *more), ["capture_id"], hot=[])


def _plain(df: DataFrame) -> DataFrame:
    return df.drop("rule_blocked", "host_blocked", positions.FILE, positions.AT)


def select_captures(
    captures: DataFrame, seeds: DataFrame, recipe: Recipe, hosts: DataFrame | None = None, links: DataFrame | None = None
) -> DataFrame:
    """The captures a recipe keeps, before its size and time limits."""
    allowed = candidates(captures, seeds, recipe, hosts, hopping=links is not None and recipe.extra_hops > 0)
    return _plain(bodies(allowed, decide(allowed, seeds, recipe, links)))


def build_archive(
    captures: DataFrame,
    seeds: DataFrame,
    recipe: Recipe,
    hosts: DataFrame | None = None,
    links: DataFrame | None = None,
    sitemap: DataFrame | None = None,
    mapping: DataFrame | None = None,
    overrides: DataFrame | None = None,
) -> Built:
    """Select, judge and store.  The target and the limits are checked before
    any costly step; a hard limit or too many failures leave no archive.

    ``captures`` has a unique ``capture_id``.  ``links`` (src, dst) confine the
    crawl to what the seeds reach; pages of ``sitemap`` (loc, lastmod) within the
    recipe's dates are seeds too; ``mapping`` moves origins; ``overrides`` are
    metadata.  With ``html`` among the columns, metadata come from the homepages; with
    ``redirect_to`` and links, redirects are followed."""
    size = scope.exclusive(recipe.size_soft_limit, recipe.size_hard_limit)
    time = scope.exclusive(recipe.time_soft_limit, recipe.time_hard_limit)
    try:
        sinks.check_target(captures.sparkSession, recipe.output, recipe.overwrite)
    except sinks.ArchiveExists as refused:
        return Built(refused.exit_code, "rejected", False)

    if sitemap is not None:
        dated = scope.sitemap_between(sitemap, recipe.sitemap_from, recipe.sitemap_to)
        more = canonical.clean_urls(dated, "loc").join(seeds.select("url"), "url", "left_anti")
        last = seeds.agg(F.max("pos")).first()[0] or 0  # after the seeds given, so the homepage stays
        seeds = written(seeds.select("pos", "url").unionByName(more.select(F.lit(last + 1).alias("pos"), "url")), "seeds")
    found = positions.located(captures)
    bad_urls = captures.filter(U.unusable("url")).count()
    allowed = candidates(captures if found is None else found, seeds, recipe, hosts, mapping, hopping=links is not None and recipe.extra_hops > 0)
    redirects = None
    if links is not None and {"redirect_to", "status", "ts"} <= set(captures.columns):
        moves = graph.redirect_map(captures.withColumn("url", U.strip_fragment("url", recipe.allow_hash)))
        redirects = written(moves.withColumn("dst", U.strip_fragment("dst", recipe.allow_hash)), "redirect-map")
    kept = decide(allowed, seeds, recipe, links, redirects)
    partial = False
    for limit, by, code in ((size, "bytes", report.EXIT_SIZE_LIMIT), (time, "elapsed", report.EXIT_TIME_LIMIT)):
        if limit:
            cut = scope.limit_cut(kept, limit[0], by, limit[1])
            if cut.partial and limit[1] == "hard":
                return Built(code, "failed", False)
            kept, partial = cut.df, partial or cut.partial

    judged = scope.with_failed(kept, recipe.invalid_status_fails)
    stats = report.crawl_stats(judged, page_limit=recipe.max_page_limit or recipe.page_limit).first().asDict(recursive=True)
    if recipe.fail_on_failed_seed and not report.failed_seeds(seeds, judged).isEmpty():
        return Built(FAILED_PAGES, "failed", partial, stats)
    if recipe.fail_on_failed_limit and stats["failed"] > recipe.fail_on_failed_limit:
        return Built(FAILED_PAGES, "failed", partial, stats)
    store(found, allowed, kept, recipe, mapping)

    stored = captures.sparkSession.read.parquet(recipe.output)
    sinks.build_index(stored).write.mode("overwrite").parquet(recipe.output + "-index")
    done = stored.agg(F.count("*").alias("done"))
    progress = done.withColumns({"total": F.lit(stats["total"]).cast("bigint"), "partial": F.lit(partial)})
    metadata = report.site_metadata(stored, seeds, overrides) if "html" in stored.columns else None
    if recipe.text and "html" in stored.columns:
        sinks.write_page_list(stored, recipe.output + "-pages", recipe.overwrite)
    if recipe.rollover_size:
        starts = sinks.shard_starts(stored, recipe.rollover_size)
        starts.write.mode("overwrite").parquet(recipe.output + "-shards")
    agents = None
    if recipe.user_agent_suffix is not None and {"user_agent", "rec_type", "collection"} <= set(captures.columns):
        agents = report.ua_audit(captures, recipe.user_agent_suffix)
    return Built(report.EXIT_OK, "partial" if partial else "complete", partial, stats, progress, metadata, bad_urls, agents)


def store(found: DataFrame | None, allowed: DataFrame, kept: DataFrame, recipe: Recipe, mapping: DataFrame | None = None) -> None:
    """Write the captures of ``kept``.  Located ones are picked by their places; a
    repeat that points to its first, which needs that id, is joined like all others."""
    repeats = "revisit_of" in kept.columns
    parts: list[DataFrame] = []
    if found is None:
        parts = [_plain(bodies(allowed, kept))]
    else:
        firsts = kept.filter("revisit_of is null") if repeats else kept
        parts = list(picked(found, firsts, recipe, mapping))
        if repeats:
            parts = [p.withColumn("revisit_of", F.lit(None).cast(kept.schema["revisit_of"].dataType)) for p in parts]
            parts.append(_plain(bodies(allowed, kept.filter("revisit_of is not null"))))
    for number, part in enumerate(parts):
        sinks.write_archive(part, recipe.output, recipe.overwrite, recipe.buckets, recipe.made_by, more=number > 0)
