"""First, last and newest of each group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import urls as U
from strandline.operators import positions
from strandline.operators.graph import chain_end
from strandline.operators.skew import first_n, hot_in, lookup_join
from strandline.session import written

# The policies, the default first.
DEDUP_POLICIES = ("skip", "revisit", "keep")


def _keyed(df: DataFrame, key: Sequence[str], uid: str) -> tuple[DataFrame, list[str]]:
    """URL keys are compared cleaned, unusable URLs as they are.  A capture
    without a key value (no digest) equals no other."""
    names = []
    for i, column in enumerate(key):
        value = F.coalesce(U.clean_url(column), F.col(column)) if column == "url" else F.col(column).cast("string")
        names.append(f"key_{i}")
        df = df.withColumn(names[-1], F.coalesce(value, F.concat(F.lit("\0"), F.col(uid).cast("string"))))
    return df, names


def dedup(
    df: DataFrame,
    policy: str = "skip",
    key: Sequence[str] = ("url", "digest"),
    order: Sequence[str] = ("ts", "capture_id"),
) -> DataFrame:
    """skip: the first capture of each key.  revisit: all captures, repeats with
    the id of the first in ``revisit_of``.  keep: all captures.

    skip ranks with a limit of one, which Spark applies in each task before the
    shuffle.  revisit finds the firsts with a partial aggregate and joins them
    back with hot keys salted: no key's captures meet in one task.

    Captures read from Parquet files with more columns than key and order are ranked
    by those alone; skip then reads whole rows by their places, so that no body is
    in an exchange."""
    if policy not in DEDUP_POLICIES:
        raise ValueError(f"policy is one of {', '.join(DEDUP_POLICIES)}")
    if policy == "keep":
        return df
    uid = order[-1]
    keyed, names = _keyed(df, key, uid)
    if policy == "skip":
        wide = set(df.columns) - {*key, *order}
        found = positions.located(df) if wide else None
        if found is not None:
            thin = found.select(*dict.fromkeys([*key, *order]), positions.FILE, positions.AT)
            marks = written(positions.bitmaps(dedup(thin, "skip", key, order), first_here=F.lit(True)), "positions")
            return reduce(DataFrame.unionByName, positions.selected(found, marks, "first_here")).select(*df.columns)
        rank = F.row_number().over(Window.partitionBy(*names).orderBy(*order))
        return keyed.withColumn("key_rank", rank).filter("key_rank = 1").select(*df.columns)
    firsts = keyed.groupBy(*names).agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("n"))
    firsts = written(firsts.select(*names, F.col(f"first.{uid}").alias("first_id"), "n"), "firsts")
    hot = hot_in(firsts, names, "n")
    joined = lookup_join(keyed, firsts.drop("n"), names, "left", spread=[uid], measure=False, hot=hot)
    repeat = F.when(F.col("first_id") != F.col(uid), F.col("first_id"))
    return joined.withColumn("revisit_of", repeat).select(*df.columns, "revisit_of")


def final_attempt(
    df: DataFrame, max_retries: int = 2, url: str = "url", order: Sequence[str] = ("attempt", "capture_id")
) -> DataFrame:
    """One row per page: its first success within 1 + ``max_retries`` attempts,
    else the last permitted one.  Needs ``failed``; adds ``attempts_used``."""
    permitted = first_n(df, [url], [F.col(c) for c in order], 1 + max_retries, spread=order)
    tries = permitted.withColumn("nth", F.row_number().over(Window.partitionBy(url).orderBy(*order)))
    preference = F.struct(F.col("failed"), F.when(F.col("failed"), -F.col("nth")).otherwise(F.col("nth")))
    rest = F.struct(*[c for c in df.columns if c != url], F.col("nth").cast("bigint").alias("attempts_used"))
    picked = tries.groupBy(url).agg(F.min_by(rest, preference).alias("pick"))
    return picked.select(url, "pick.*")


def retain_latest(
    df: DataFrame, n: int = 5, per: Sequence[str] = ("crawl_id",), order: Sequence[str] = ("ts", "state_id")
) -> DataFrame:
    """The newest ``n`` states of each crawl."""
    return first_n(df, per, [F.col(c).desc() for c in order], n, spread=order)


def homepage(seeds: DataFrame, redirects: DataFrame) -> DataFrame:
    """The first seed and where it leads: one row (url, homepage).  ``redirects``
    has src and dst, one row per src; only the seed's own chain is followed.  A
    looping seed stays itself."""
    first = seeds.agg(F.min_by("url", "pos").alias("url")).first().url
    end = chain_end(redirects, first) if first is not None else None
    return seeds.sparkSession.createDataFrame([(first, end or first)], "url string, homepage string")
