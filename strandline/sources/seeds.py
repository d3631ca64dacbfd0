"""Sources a crawl starts from: seeds, sitemaps, earlier runs, logs."""

from __future__ import annotations

import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import urls as U
from strandline.operators.canonical import clean_urls
from strandline.operators.ordered import prefix_sum

# Line ends that the text source does not know.
MORE_LINE_ENDS = r"[\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"

# Log contexts, and those left out unless asked for.
LOG_CONTEXTS = (
    "general", "worker", "recorder", "recorderNetwork", "writer", "state", "redis", "storage",
    "text", "exclusion", "screenshots", "screencast", "originOverride", "healthcheck", "browser", "blocking",
    "behavior", "behaviorScript", "jsError", "fetch", "pageStatus", "memoryStatus", "crawlStatus", "links",
    "sitemap", "wacz", "replay", "proxy",
)
LOG_EXCLUDED = ("recorderNetwork", "jsError", "screencast")
LOG_SCHEMA = "ts timestamp, level string, context string, message string"


class NoSeedsError(ValueError):
    """Neither inline seeds nor a seed file gave a URL."""


class NoRunsError(FileNotFoundError):
    """No archive folder of an earlier run was found."""


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(i, raw): the lines of a text file numbered from 0.  The file may be read
    in splits by many tasks: a line's place is its split's offset and its place
    in the split, and the numbers come from a prefix sum over that."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.posexplode(F.split("value", MORE_LINE_ENDS)).alias("sub", "raw"),
    )
    numbered = prefix_sum(lines.withColumn("one", F.lit(1)), "one", ["file", "block", "row", "sub"])
    return numbered.select(F.col("before").alias("i"), "raw")


def load_seeds(spark: SparkSession, inline: str | None = None, path: str | None = None) -> DataFrame:
    """(pos, url): the comma list, then the file's lines, in order and cleaned.

    Inline items are taken as they are; blank lines give empty seeds and URLs
    that cannot be used give null.  Position 0 is the homepage."""
    items = inline.split(",") if inline else []
    seeds = spark.createDataFrame(list(enumerate(items)), "i bigint, raw string")
    if path:
        lines = _numbered_lines(spark, path)
        if not items and lines.isEmpty():
            raise NoSeedsError(f"no seeds in {path}")
        seeds = seeds.unionByName(lines.withColumn("i", F.col("i") + len(items))) if items else lines
    elif not items:
        raise NoSeedsError("give inline seeds or a seed file")
    return seeds.select(F.col("i").alias("pos"), U.clean_url("raw").alias("url"))


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(loc, lastmod) of sitemap XML files."""
    schema = "loc string, lastmod string"
    trimmed = [F.trim(c).alias(c) for c in ("loc", "lastmod")]
    return spark.read.schema(schema).option("rowTag", "url").xml(path).select(*trimmed).filter("loc <> ''")


def with_sitemap(seeds: DataFrame, sitemap: DataFrame) -> DataFrame:
    """Distinct URLs of both: what the crawl starts from."""
    extra = clean_urls(sitemap, "loc")
    return seeds.select("url").filter(F.col("url").isNotNull()).unionByName(extra).distinct()


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines crawl logs."""
    return spark.read.schema(LOG_SCHEMA).json(path)


def _names(value: str | Sequence[str] | None) -> list[str]:
    return [v.strip() for v in value.split(",")] if isinstance(value, str) else list(value or ())


def filter_logs(
    df: DataFrame,
    levels: str | Sequence[str] | None = None,
    contexts: str | Sequence[str] | None = None,
    exclude: str | Sequence[str] | None = LOG_EXCLUDED,
) -> DataFrame:
    """Keep the listed levels and contexts, drop the excluded contexts; a row
    without context is none of them.  Plain set tests on columns, so they reach a
    parquet scan."""
    keep, drop = _names(contexts), _names(exclude)
    unknown = set(keep + drop) - set(LOG_CONTEXTS)
    if unknown:
        raise ValueError(f"unknown log contexts: {', '.join(sorted(unknown))}")
    if _names(levels):
        df = df.filter(F.col("level").isin(_names(levels)))
    if keep:
        df = df.filter(F.col("context").isin(keep))
    return df.filter(F.col("context").isNull() | ~F.col("context").isin(drop)) if drop else df


def run_folders(spark: SparkSession, root: str, collection: str | None = None) -> list[tuple[str, str, int]]:
    """(path, collection, time of change in ms) of archive folders, oldest first.  Of a
    named collection exactly ``root``/collections/name/archive; else every
    collections/crawl-*/archive below ``root``, at any depth, though an archive is not
    searched further.  Folders are listed side by side, a level at a time."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    top = path(root)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    if collection is not None:
        named = path(path(path(top, "collections"), collection), "archive")
        if system.exists(named) and system.getFileStatus(named).isDirectory():
            found.append((named.toString(), collection, system.getFileStatus(named).getModificationTime()))
        return found

    def folders(at: object) -> list:
        return [s for s in system.listStatus(at) if s.isDirectory()]

    level = [(top, ())] if system.exists(top) and system.getFileStatus(top).isDirectory() else []
    with ThreadPoolExecutor(16) as pool:
        while level:
            below = []
            for (_, names), inside in zip(level, pool.map(lambda x: folders(x[0]), level)):
                for status in inside:
                    under = (*names[-2:], status.getPath().getName())
                    if len(under) == 3 and under[0] == "collections" and under[1].startswith("crawl-") and under[2] == "archive":
                        found.append((status.getPath().toString(), under[1], status.getModificationTime()))
                    else:
                        below.append((status.getPath(), under))
            level = below
    return sorted(found, key=lambda f: (f[2], f[0]))


def union_collections(
    spark: SparkSession, root: str, collection: str | None = None, format: str = "parquet"
) -> DataFrame:
    """The captures of one collection, or of every collections/``crawl-*`` run
    below ``root``, at any depth, with ``collection`` and ``run_no``: 1 for the archive
    folder changed first.  Runs of one name in two places are two runs.

    A name is taken as it is, whatever characters it has.  Order and names come from
    the folders alone: no file is read for them.  ``format`` may be ``warc`` once that
    source is registered."""
    folders = run_folders(spark, root, collection)
    if not folders:
        raise NoRunsError(f"no archive folder at {root}/**/collections/{collection or 'crawl-*'}/archive")

    def load(folder: str) -> DataFrame:
        literal = re.sub(r"([\\{}\[\]*?])", r"\\\1", folder) if format != "warc" else folder
        return spark.read.format(format).load(literal)

    runs = [load(path).withColumns({"collection": F.lit(name), "run_no": F.lit(number)}) for number, (path, name, _) in enumerate(folders, 1)]
    return reduce(DataFrame.unionByName, runs)
