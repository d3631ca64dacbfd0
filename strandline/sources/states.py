"""Saved crawl states: what is still pending, kept for the next run."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sources.sinks import exists

# When a state is saved, the default first.
SAVE_STATES = ("partial", "never", "always")


def save_state(
    pending: DataFrame, root: str, crawl_id: str, policy: str = "partial", interrupted: bool = False
) -> str | None:
    """Store the frontier of a crawl; ``partial`` does so only on interruption.
    Gives the path, or None if nothing was saved."""
    if policy not in SAVE_STATES:
        raise ValueError(f"policy is one of {', '.join(SAVE_STATES)}")
    if policy == "never" or (policy == "partial" and not interrupted):
        return None
    path = f"{root}/{crawl_id}/state-{time.time_ns():020d}"
    pending.write.parquet(path)
    return path


def saved_states(spark: SparkSession, root: str) -> DataFrame:
    """(crawl_id, state_id, ts) of every state, from the file listing alone."""
    schema = "crawl_id string, state_id string, ts timestamp"
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    place = r"/([^/]+)/(state-[0-9]+)/[^/]*$"
    named = files.select(
        F.regexp_extract("path", place, 1).alias("crawl_id"), F.regexp_extract("path", place, 2).alias("state_id"), "modificationTime"
    )
    return named.groupBy("crawl_id", "state_id").agg(F.max("modificationTime").alias("ts")).filter("state_id <> ''")


def load_state(spark: SparkSession, root: str, crawl_id: str) -> DataFrame | None:
    """The newest complete frontier of a crawl, to go on from.  A folder without
    the writer's success mark was left half done."""
    of_crawl = saved_states(spark, root).filter(F.col("crawl_id") == crawl_id)
    for state in of_crawl.orderBy(F.desc("state_id")).toLocalIterator():  # a handful are kept
        path = f"{root}/{crawl_id}/{state.state_id}"
        if exists(spark, f"{path}/_SUCCESS"):
            return spark.read.parquet(path)
    return None


def _manifest(spark: SparkSession, root: str, crawl_id: str) -> list[str]:
    """The folders of the newest chain: a base and what changed since, in order.  A
    manifest is written last, so a chain with a half-written folder has none."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/{crawl_id}")
    except AnalysisException:
        return []
    named = files.select(F.regexp_extract("path", r"/(manifest-[0-9]+)/(?:part-|_SUCCESS)[^/]*$", 1).alias("name")).filter("name <> ''").distinct()
    for row in named.orderBy(F.desc("name")).toLocalIterator():  # the newest but for a broken one
        path = f"{root}/{crawl_id}/{row.name}"
        if exists(spark, f"{path}/_SUCCESS"):
            return [r.folder for r in spark.read.schema("place int, folder string").json(path).orderBy("place").collect()]
    return []


def load_chain(spark: SparkSession, root: str, crawl_id: str, key: str = "url") -> DataFrame | None:
    """The frontier that :func:`save_delta` saved last: of each key the newest row of
    the chain, unless it says that the key is gone."""
    chain = _manifest(spark, root, crawl_id)
    if not chain:
        return None
    parts = [spark.read.parquet(f"{root}/{crawl_id}/{folder}").withColumn("chain_place", F.lit(i)) for i, folder in enumerate(chain)]
    if len(parts) == 1:
        return parts[0].drop("chain_gone", "chain_place")
    every = reduce(DataFrame.unionByName, parts)
    columns = [c for c in parts[0].columns if c not in ("chain_gone", "chain_place")]
    newest = every.groupBy(F.col(key).alias("chain_key")).agg(F.max_by(F.struct(*columns, "chain_gone"), "chain_place").alias("row"))
    return newest.filter("not row.chain_gone").select(*[F.col(f"row.`{c}`").alias(c) for c in columns])


def save_delta(pending: DataFrame, root: str, crawl_id: str, key: str = "url", fold_after: int = 8) -> str:
    """Store what changed in a frontier of distinct keys since it was saved last: new
    and changed rows, and keys that are gone.  The first time, and after ``fold_after``
    deltas, the whole frontier is the new base.  Gives the folder."""
    spark, stamp = pending.sparkSession, f"{time.time_ns():020d}"
    chain = _manifest(spark, root, crawl_id)
    known = load_chain(spark, root, crawl_id, key) if chain and len(chain) <= fold_after else None
    if known is None:
        chain, name, rows = [], f"base-{stamp}", pending.withColumn("chain_gone", F.lit(False))
    else:
        name, columns = f"delta-{stamp}", pending.columns
        now, before = (df.select(F.col(key).alias("chain_key"), F.struct(*columns).alias(side)) for df, side in ((pending, "now"), (known, "before")))
        both = now.join(before, now.chain_key.eqNullSafe(before.chain_key), "full").filter(~F.col("now").eqNullSafe(F.col("before")))
        row = F.coalesce("now", "before")
        rows = both.select(*[row[c].alias(c) for c in columns], F.col("now").isNull().alias("chain_gone"))
    rows.write.parquet(f"{root}/{crawl_id}/{name}")
    listed = spark.createDataFrame(list(enumerate([*chain, name])), "place int, folder string")
    listed.coalesce(1).write.json(f"{root}/{crawl_id}/manifest-{stamp}")
    return f"{root}/{crawl_id}/{name}"
