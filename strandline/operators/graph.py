"""Links between pages: extraction, reachability, redirects, frontier.

The loops run a bounded number of actions on the driver and keep every row on
the executors; each round's rows are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import html as H
from strandline.functions import selectors
from strandline.functions import urls as U
from strandline.operators import skew
from strandline.operators.canonical import clean_urls, once
from strandline.operators.skew import key_profile, lookup_join, replicated, salted
from strandline.session import BucketedTable, written

# The redirect statuses followed.
REDIRECTS = (301, 302, 307, 308)

ROWS_PER_BUCKET = 4_000_000
MAX_BUCKETS = 50_000


def extract_links(
    pages: DataFrame,
    rules: Sequence[str] = ("a[href]->href",),
    allow_hash: bool = False,
    dedupe: bool = True,
) -> DataFrame:
    """(src, dst) of every link the rules select, resolved (against the page's
    ``<base href>`` if it has one) and cleaned.  Rules of one element are read
    tag by tag; those with combinators or lists fold the page's open elements once.

    Repeats within a page go before anything is shuffled.  ``dedupe=False``
    leaves out the shuffle; a page may then repeat a target that it spells in
    two ways, and a page crawled twice gives its links twice."""
    plain = [r for r in rules if H.RULE.match(r)]
    nested = [r for r in rules if r not in plain]
    values = [H.link_values(F.col("html"), r) for r in plain] + ([selectors.nested_link_values(F.col("html"), nested)] if nested else [])
    found = F.array_distinct(F.flatten(F.array(*values)))
    pages = pages.withColumn("base_href", H.base_href(F.col("html")))
    origin = F.when(F.col("base_href") == "", F.col("url")).otherwise(U.resolve("url", "base_href"))
    base = U.base_of(origin)._asdict()
    parts_of_page = F.struct(*[c.alias(n) for n, c in base.items()]).alias("base")
    per_page = pages.select(F.col("url").alias("src"), parts_of_page, found.alias("hrefs"))
    raw = per_page.select("src", "base", F.explode("hrefs").alias("href"))
    parts = U.Base(*[F.col(f"base.{n}") for n in base])
    other = F.col("href").rlike(r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*:") & ~F.col("href").rlike(r"^\s*(?i:https?)://[^/?#]")
    absolute = raw.filter(~other).select("src", U.resolve(parts, "href").alias("to"))
    links = once(absolute, dst=U.strip_fragment(U.clean_url("to"), allow_hash)).drop("to")
    return links.distinct() if dedupe else links


def reach(seeds: DataFrame, links: DataFrame, depth: int = -1, extra_hops: int = 0) -> DataFrame:
    """Pages reachable from the seeds: (url, depth, extra).

    ``seeds`` has ``url``; ``links`` has ``src``, ``dst`` and optionally
    ``in_scope`` for the target.  A hop out of scope uses one of ``extra_hops``,
    others none.  ``depth`` -1 goes on to the end.  A page appears once per
    state that no other state beats in both depth and extra; without extra hops
    that is once.

    The links are hashed on their source once (hot sources salted) and the
    states on their URL, so a round shuffles only the new candidates.
    """
    spark = links.sparkSession
    cost = F.when(F.col("in_scope"), 0).otherwise(1) if "in_scope" in links.columns else F.lit(0)
    steps = links.select("src", "dst", cost.alias("cost")).filter(F.col("cost") <= extra_hops)
    rows, hot = key_profile(steps, ["src"])
    buckets = min(MAX_BUCKETS, 1 + rows // ROWS_PER_BUCKET)
    graph = BucketedTable(spark, "links", ("src", "salt"), buckets)
    states = BucketedTable(spark, "reached", ("url",), buckets)
    start = seeds.select("url").filter(F.col("url").isNotNull()).distinct()
    level = 0
    try:
        graph.add(salted(steps, ["src"], hot, ["dst"]))
        states.add(start.select("url", F.lit(0).alias("depth"), F.lit(0).alias("extra")))
        while level != depth:
            frontier = states.read().filter(F.col("depth") == level).select(F.col("url").alias("src"), "extra")
            if frontier.isEmpty():
                break
            level += 1
            found = (
                replicated(frontier, ["src"], hot)
                .join(graph.read(), ["src", "salt"])
                .select(F.col("dst").alias("url"), (F.col("extra") + F.col("cost")).alias("extra"))
                .filter(F.col("extra") <= extra_hops)
                .groupBy("url")
                .agg(F.min("extra").alias("extra"))
            )
            if extra_hops:
                best = states.read().groupBy("url").agg(F.min("extra").alias("best"))
                fresh = found.join(best, "url", "left").filter(F.col("best").isNull() | (F.col("extra") < F.col("best")))
            else:
                fresh = found.join(states.read().select("url"), "url", "left_anti")
            states.add(fresh.select("url", F.lit(level).alias("depth"), "extra"))
        return states.read()
    finally:
        graph.close()
        states.close()


class Contracted(NamedTuple):
    """A graph whose redirecting URLs are replaced by where they lead."""

    seeds: DataFrame  # url
    links: DataFrame  # src, dst and the other columns of the links
    shown: DataFrame  # the links of pages that are shown, with their own targets
    ends: DataFrame  # src, end


def _moved_to(df: DataFrame, ends: DataFrame, column: str) -> DataFrame:
    """``df`` with a URL column replaced by the end of its redirects, if it has any."""
    renamed = ends.select(F.col("src").alias(column), F.col("end").alias("moved_end"))
    joined = lookup_join(df, renamed, [column], "left")
    return joined.withColumn(column, F.coalesce("moved_end", column)).select(*df.columns)


def contract(seeds: DataFrame, links: DataFrame, redirects: DataFrame) -> Contracted:
    """Contract every chain of redirects (src, dst; one row per src) to its end, so
    that a walk follows it at no cost.  A URL whose chain runs in a loop leads nowhere
    and stays a node of its own, without links; links from a redirecting URL to
    elsewhere are not followed, as no page is shown there."""
    resolved = written(resolve_redirects(redirects), "resolved")
    ends = written(resolved.filter(~F.col("loop") & (F.col("src") != F.col("target"))).select("src", F.col("target").alias("end")), "chain-ends")
    gone = resolved.filter(F.col("loop") | (F.col("src") != F.col("target"))).select("src")
    shown = lookup_join(links, gone, ["src"], "left_anti", spread=["dst"])
    return Contracted(_moved_to(seeds.select("url"), ends, "url").distinct(), _moved_to(shown, ends, "dst"), shown, ends)


def reach_redirected(seeds: DataFrame, links: DataFrame, redirects: DataFrame, depth: int = -1, extra_hops: int = 0) -> DataFrame:
    """As :func:`reach`, over redirects, which are no hops: (url, depth, extra, via).

    ``via`` is false for pages and for loops, and true for the redirecting URLs that
    the walk goes through: seeds, targets of links of reached pages, and what lies on
    their chains.  Those have the depth and extra at which they are first met.  The
    URLs of all three tables are cleaned, relative targets resolved (as by
    :func:`redirect_map`)."""
    graph = contract(seeds, links, redirects)
    pages = written(reach(graph.seeds, graph.links, depth, extra_hops), "reached-pages")
    cost = F.when(F.col("in_scope"), 0).otherwise(1) if "in_scope" in links.columns else F.lit(0)
    moving = written(redirects.filter("src <> dst").select("src", F.col("dst").alias("to")), "moving")
    origin = graph.shown.select("src", "dst", cost.alias("cost")).join(pages.withColumnRenamed("url", "src"), "src")
    met = origin.select(F.col("dst").alias("url"), (F.col("depth") + 1).alias("depth"), (F.col("extra") + F.col("cost")).alias("extra"))
    met = met.filter(F.col("extra") <= extra_hops) if depth < 0 else met.filter((F.col("extra") <= extra_hops) & (F.col("depth") <= depth))
    zero = F.lit(0)
    met = met.unionByName(seeds.select("url").filter("url is not null").select("url", zero.alias("depth"), zero.alias("extra")))
    first = met.groupBy("url").agg(F.min(F.struct("depth", "extra")).alias("at"))
    sources = moving.select(F.col("src").alias("url"))
    seen = written(first.join(sources, "url", "left_semi"), "met-redirects")
    passed, front = [seen], seen
    while not front.isEmpty():  # a hop of all chains a round; a loop ends where it meets itself
        ahead = front.join(moving.withColumnRenamed("src", "url"), "url").groupBy(F.col("to").alias("url")).agg(F.min("at").alias("at"))
        known = reduce(DataFrame.unionByName, passed).groupBy("url").agg(F.min("at").alias("known"))
        ahead = ahead.join(sources, "url", "left_semi").join(known, "url", "left").filter(F.col("known").isNull() | (F.col("at") < F.col("known")))
        front = written(ahead.select("url", "at"), "met-redirects")
        passed.append(front)
    via = reduce(DataFrame.unionByName, passed).groupBy("url").agg(F.min("at").alias("at"))
    via = via.join(pages.select("url"), "url", "left_anti")  # loops are pages already
    return pages.withColumn("via", F.lit(False)).unionByName(via.select("url", "at.depth", "at.extra", F.lit(True).alias("via")))


def redirect_map(captures: DataFrame) -> DataFrame:
    """(src, dst): the newest redirect of each URL, both cleaned."""
    hops = captures.filter(F.col("status").isin(*REDIRECTS) & F.col("redirect_to").isNotNull())
    located = hops.select("ts", "url", U.resolve("url", "redirect_to").alias("to"))
    cleaned = once(located, src=U.clean_url("url"), dst=U.clean_url("to")).select("ts", "src", "dst")
    newest = cleaned.groupBy("src").agg(F.max(F.struct("ts", "dst")).alias("m"))
    return newest.select("src", F.col("m.dst").alias("dst"))


def resolve_redirects(redirects: DataFrame) -> DataFrame:
    """Where each redirect ends: (src, target, hops, loop).

    ``redirects`` has one row per ``src``.  Each round doubles the distance
    looked ahead, so a chain of n hops takes about log2(n) rounds.  Round r
    finishes the sources 2^(r-1) to 2^r - 1 hops from their end; every longer
    chain holds such a source, so a round that finishes none proves that the
    rest run in loops.  Their target and hops are null.
    """
    self_hop = F.col("src") == F.col("dst")
    state = written(
        redirects.select(
            "src",
            F.col("dst").alias("at"),
            F.when(self_hop, 0).otherwise(1).cast("bigint").alias("hops"),
            self_hop.alias("done"),
        ),
        "redirects",
    )
    finished, active = [state.filter("done")], state.filter(~F.col("done"))
    left = active.count()
    while left:
        ahead = reduce(DataFrame.unionByName, [*finished, active]).select(
            F.col("src").alias("at"), F.col("at").alias("at2"), F.col("hops").alias("hops2"), F.col("done").alias("done2")
        )
        few = [] if left < skew.HOT_ROWS else None  # too few rows for any key to be hot
        moved = lookup_join(active, ahead, ["at"], "left", ["src"], measure=False, hot=few)
        moved = moved.select(
            "src",
            F.coalesce("at2", "at").alias("at"),
            (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops"),
            F.coalesce("done2", F.lit(True)).alias("done"),
        )
        moved = written(moved, "redirects")  # finished rows stay where they were first written
        finished.append(moved.filter("done"))
        active = moved.filter(~F.col("done"))
        before, left = left, active.count()
        if left == before:
            break
    return reduce(DataFrame.unionByName, [*finished, active]).select(
        "src",
        F.when(F.col("done"), F.col("at")).alias("target"),
        F.when(F.col("done"), F.col("hops")).alias("hops"),
        (~F.col("done")).alias("loop"),
    )


def chain_end(redirects: DataFrame, url: str) -> str | None:
    """Where one URL leads, hop by hop: a filtered read each, and no other chain is
    followed.  A URL without redirect is its own end; a loop has none."""
    seen = [url]
    while True:
        hop = redirects.filter(F.col("src") == seen[-1]).select("dst").first()
        if hop is None or hop.dst == seen[-1]:
            return seen[-1]
        if hop.dst in seen:
            return None
        seen.append(hop.dst)


def frontier(discovered: DataFrame, captures: DataFrame) -> DataFrame:
    """Discovered URLs that no capture has visited, cleaned and distinct.  Both
    sides shrink to distinct URLs before they meet."""
    return clean_urls(discovered).join(clean_urls(captures), "url", "left_anti")
