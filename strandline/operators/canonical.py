"""URL normalisation as a job over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import urls as U
from strandline.operators.skew import lookup_join


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds a column that is costly to compute and drops the rows where it is
    null.  A filter on a computed column is pushed below the projection, so its
    expression would run twice per row and nest in the next one; a generator
    computes it once."""
    for name, value in columns.items():
        df = df.select(*[c for c in df.columns if c != name], F.explode(F.array_compact(F.array(value))).alias(name))
    return df


def clean_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """The distinct usable URLs of a table, cleaned: (url)."""
    return once(df.select(F.col(url).alias("url")), url=U.clean_url("url")).distinct()


def canonicalise(df: DataFrame, url: str = "url", allow_hash: bool = False) -> DataFrame:
    """Adds ``clean`` (default port dropped, fragment policy applied) and
    ``entry`` (host + path); ``clean`` is null for URLs that cannot be used."""
    cleaned = df.withColumn("clean", U.strip_fragment(U.clean_url(url), allow_hash))
    return cleaned.withColumn("entry", U.entry_path("clean"))


def collisions(df: DataFrame, url: str = "url", allow_hash: bool = False) -> DataFrame:
    """Per entry: how many spellings of its URL there are, how many captures,
    and how many captures the commonest spelling has.

    Spellings are counted before the entry-level shuffle, so an entry that owns
    a large part of the captures sends one row per task and spelling."""
    spelled = canonicalise(df, url, allow_hash).groupBy("entry", F.col(url).alias("spelling"))
    return (
        spelled.agg(F.count("*").alias("n"))
        .groupBy("entry")
        .agg(F.count("*").alias("variants"), F.sum("n").alias("captures"), F.max("n").alias("largest_variant"))
    )


def override_origin(df: DataFrame, mapping: DataFrame, url: str = "url") -> DataFrame:
    """Move URLs to another origin.  ``mapping`` has ``origin`` and
    ``replacement`` (scheme://host[:port]), one row per origin."""
    table = mapping.select(F.lower("origin").alias("origin"), "replacement")
    joined = lookup_join(df.withColumn("origin", U.origin(url)), table, ["origin"], "left", spread=[url])
    moved = F.concat("replacement", F.substring(F.col(url), F.length("origin") + 1, F.length(url)))
    return joined.withColumn(url, F.coalesce(moved, F.col(url))).select(*df.columns)
