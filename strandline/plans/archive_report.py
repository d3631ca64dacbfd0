"""The flagship report: what an archive holds per host."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import urls as U
from strandline.operators.rank import dedup
from strandline.operators.scope import block_hosts, exclude_rx, with_failed


def host_report(captures: DataFrame, blocklist: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Per host: crawl statistics, distinct pages and bytes, after the fragment
    policy, exclude rules, host blocklist and deduplication.

    Filters run in the scan's stage and deduplication trims repeats before its
    shuffle.  The host counts come from a partial aggregate."""
    thin = captures.select("capture_id", "ts", "url", "host", "status", "bytes", "digest")
    in_policy = exclude_rx(thin, exclude).withColumn("url", U.strip_fragment("url"))
    kept = dedup(block_hosts(in_policy, blocklist), "skip")
    judged = with_failed(kept, invalid_status_fails=True)
    per_page = judged.groupBy("host", "url").agg(
        F.count("*").alias("n"), F.count_if("failed").alias("bad"), F.sum("bytes").alias("size")
    )
    return per_page.groupBy("host").agg(
        F.count("*").alias("pages"),
        (F.sum("n") - F.sum("bad")).alias("crawled"),
        F.sum("bad").alias("failed"),
        F.sum("n").alias("total"),
        F.sum("size").alias("bytes"),
    )
