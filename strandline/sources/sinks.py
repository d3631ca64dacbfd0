"""Archive output: tables, index, shards, compaction, page text."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline import __version__
from strandline.functions import html as H
from strandline.functions import urls as U
from strandline.operators.ordered import prefix_sum
from strandline.operators.skew import lookup_join
from strandline.session import written

ROLLOVER_BYTES = 1_000_000_000  # fixed value: the default shard size


class ArchiveExists(FileExistsError):
    """The target is there and overwriting was not asked for."""

    exit_code = 2


def provenance(*extra: str) -> str:
    """The versions of all tools that made an archive."""
    return "; ".join([f"strandline {__version__}", f"spark {pyspark.__version__}", *extra])


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise
    return True


def check_target(spark: SparkSession, path: str, overwrite: bool = False) -> None:
    """Refuse a taken target.  Call it before the costly steps too."""
    if not overwrite and exists(spark, path):
        raise ArchiveExists(f"{path} exists; pass overwrite=True to replace it")


def write_archive(
    df: DataFrame, path: str, overwrite: bool = False, buckets: int = 64, made_by: Sequence[str] = (), url: str = "url", more: bool = False
) -> None:
    """Store captures in ``buckets`` folders by host hash (a folder per host
    would be far too many), with a ``provenance`` column.  The rebalance step
    merges small and splits large buckets into files of even size, so a bucket
    with most of the rows is written by many tasks.  ``more`` adds to an archive that
    this job has begun."""
    if not more:
        check_target(df.sparkSession, path, overwrite)
    bucket = F.pmod(F.xxhash64(U.host(url)), F.lit(buckets)).cast("int")
    placed = df.withColumns({"host_bucket": bucket, "provenance": F.lit(provenance(*made_by))})
    mode = "append" if more else "overwrite" if overwrite else "errorifexists"
    placed.hint("rebalance", "host_bucket").write.mode(mode).partitionBy("host_bucket").parquet(path)


def build_index(captures: DataFrame) -> DataFrame:
    """Lookup index sorted by reversed host and path, then time.  Ranges are cut
    on the whole sort key, so a hot host or URL spreads over many."""
    order = ["key", "ts", "capture_id"]
    columns = ["url", "status", "mime", "digest", "bytes"]
    index = captures.select(
        U.sort_key("url").alias("key"), "ts", "capture_id", *[c for c in columns if c in captures.columns]
    )
    return index.repartitionByRange(*order).sortWithinPartitions(*order)


def write_index(captures: DataFrame, path: str) -> None:
    """Store the lookup index, and beside it (``path``-blocks) the first and last key
    of each of its files: a sparse index, a row per file."""
    build_index(captures).write.parquet(path)
    stored = captures.sparkSession.read.parquet(path)
    blocks = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("rows")
    )
    blocks.write.parquet(path + "-blocks")


def lookup(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """The index rows whose key begins with ``prefix`` (a whole key finds its URL, and
    what goes on from it).  Only files whose keys enclose it are read, and of those
    the row groups that may hold it."""
    blocks = spark.read.parquet(path + "-blocks")
    around = blocks.filter((F.substring("first_key", 1, len(prefix)) <= prefix) & (F.col("last_key") >= prefix))
    files = [row.file for row in around.select("file").collect()]
    stored = spark.read.schema(spark.read.parquet(path).schema)
    return (stored.parquet(*files) if files else stored.parquet(path).limit(0)).filter(F.col("key").startswith(prefix))


def nearest(index: DataFrame, queries: DataFrame, uid: str = "capture_id", url: str = "url") -> DataFrame:
    """The capture nearest in time to each query (``url``, ``ts`` and what else it has):
    the query's columns, ``key``, ``nearest_id`` and ``nearest_ts`` (null if the URL was
    never captured: URLs of one key, as with other fragments, are told apart).  Of two at
    one distance the earlier is taken, then the smaller id.

    An as-of join in cells of one URL and hour, so a URL with most of the captures is
    many groups.  Within a cell rows are put in order; what lies beyond it comes from
    the first and last capture of the URL's other cells, one row each."""
    own = F.struct(*queries.columns).alias("query")
    asked = queries.select(own, F.col(url).alias("url"), F.col("ts").cast("timestamp").alias("ts"))
    known = index.select("url", F.col("ts").cast("timestamp").alias("ts"), F.col(uid).cast("bigint").alias("id")).filter("ts is not null")
    known = lookup_join(known, asked.select("url").distinct(), ["url"], "left_semi", spread=["id"])
    cell = F.date_trunc("hour", "ts").alias("cell")
    rows = known.select("url", cell, "ts", F.struct("ts", (-F.col("id")).alias("less")).alias("before"), F.struct("ts", "id").alias("after"), F.lit(None).cast(asked.schema["query"].dataType).alias("query"), F.lit(0).alias("asks"))
    none = lambda c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
    rows = rows.unionByName(asked.select("url", cell, "ts", none("before"), none("after"), "query", F.lit(1).alias("asks")))
    cells = rows.groupBy("url", "cell").agg(F.max("before").alias("last"), F.min("after").alias("first"))
    by_cell = Window.partitionBy("url").orderBy("cell")  # a row per hour in which the URL was captured
    cells = cells.select(
        "url", "cell", F.max("last").over(by_cell.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"),
        F.min("first").over(by_cell.rowsBetween(1, Window.unboundedFollowing)).alias("later"),
    )
    inside = Window.partitionBy("url", "cell").orderBy("ts", "asks")
    placed = rows.select(
        "url", "cell", "ts", "query", "asks", F.max("before").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("before"),
        F.min("after").over(inside.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    ).filter("asks = 1")
    same = placed["url"].eqNullSafe(cells["url"]) & placed["cell"].eqNullSafe(cells["cell"])
    found = placed.join(cells, same).select(placed["url"], placed["ts"], "query", F.coalesce("before", "earlier").alias("b"), F.coalesce("after", "later").alias("a"))
    apart = lambda c: F.abs(F.unix_micros(f"{c}.ts") - F.unix_micros("ts"))
    take_before = F.col("a").isNull() | (apart("b") <= apart("a"))
    return found.select(
        *[F.col(f"query.{c}").alias(c) for c in queries.columns], U.sort_key(found["url"]).alias("key"),
        F.when(take_before, -F.col("b.less")).otherwise(F.col("a.id")).alias("nearest_id"),
        F.when(take_before, F.col("b.ts")).otherwise(F.col("a.ts")).alias("nearest_ts"),
    )


def rollover(df: DataFrame, max_bytes: int = ROLLOVER_BYTES, order: Sequence[str] = ("ts", "capture_id")) -> DataFrame:
    """Adds ``shard``: a new one starts at every multiple of ``max_bytes`` of
    the bytes before.  (A writer that fills files one by one lets each run over
    by its last record, so its cuts come slightly later.)  ``order`` ends in a
    unique id."""
    uid = order[-1]
    summed = prefix_sum(df.select(*order, "bytes"), "bytes", order)  # bodies stay where they are
    shards = summed.select(uid, F.expr(f"before div {int(max_bytes)}").alias("shard"))
    return df.join(shards, uid).select(*df.columns, "shard")


SPAN = 16  # shards' worth of bytes in a range that one task cuts


def shard_starts(df: DataFrame, max_bytes: int = ROLLOVER_BYTES, order: Sequence[str] = ("ts", "capture_id")) -> DataFrame:
    """(shard, before, *order): where a writer that fills one file after the other
    starts a new one, which it does when its file has reached ``max_bytes``.

    Each cut depends on the one before, yet no task goes through all rows.  Prefix sums
    are cut into ranges of ``SPAN`` shards.  In a range any row up to the first shard's
    length may be where the cuts enter it; for all of those at once, the next cut is
    found by binary search until the range is left.  The ranges are then chained by
    pointer jumping: each round doubles the ranges a pointer leaps over.  Driver and
    closures see two numbers a range."""
    width = max_bytes * SPAN
    summed = prefix_sum(df.select(*order, F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes")), "bytes", order)
    places = summed.groupBy("before").agg(F.min(F.struct(*order)).alias("at")).withColumn("part", F.expr(f"before div {width}"))
    places = written(places, "places")
    bounds = places.groupBy("part").agg(F.min("before").alias("lo"), F.max("before").alias("hi")).orderBy("part").toPandas()
    parts, lows, highs = (bounds[c].to_numpy(np.int64) for c in ("part", "lo", "hi"))

    def hops(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        sums = np.sort(table.column("before").to_numpy())
        at = np.arange(min(len(sums), int(np.searchsorted(sums, part * width + max_bytes)) + 1))
        entry = sums[at]
        while True:
            following = np.searchsorted(sums, sums[at] + max_bytes)
            inside = following < len(sums)
            if not inside.any():
                break
            at = np.where(inside, following, at)
        leaves = sums[at] + max_bytes
        lands = np.searchsorted(highs, leaves)  # the first range with a row that far
        ends = lands == len(parts)
        lands[ends] = 0
        columns = [entry, np.full(len(entry), part), np.maximum(leaves, lows[lands]), parts[lands]]
        return pa.table({n: pa.array(c, pa.int64(), mask=ends if i > 1 else None) for i, (n, c) in enumerate(zip(("entry", "part", "leaves", "lands"), columns))})

    schema = "entry bigint, part bigint, leaves bigint, lands bigint"
    leaps = written(places.select("part", "before").groupBy("part").applyInArrow(hops, schema), "leaps")

    def landed(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        entries = np.sort(right.column("entry").to_numpy())
        to = entries[np.searchsorted(entries, left.column("leaves").to_numpy())] if left.num_rows else np.zeros(0, np.int64)
        return pa.table({"entry": left.column("entry"), "to": pa.array(to, pa.int64())})

    going = leaps.filter("lands is not null").select("entry", "leaves", "lands")
    pointers = written(going.groupBy("lands").cogroup(leaps.select(F.col("entry"), F.col("part").alias("of")).groupBy("of")).applyInArrow(landed, "entry bigint, to bigint"), "pointers")
    visited = leaps.agg(F.min("entry").alias("entry")).filter("entry is not null")
    while True:
        more = written(visited.join(pointers, "entry").select(F.col("to").alias("entry")).join(visited, "entry", "left_anti"), "visited")
        if more.isEmpty():
            break
        visited = written(visited.unionByName(more), "visited")
        twice = pointers.select(F.col("entry").alias("to"), F.col("to").alias("then"))
        pointers = written(pointers.join(twice, "to").select("entry", F.col("then").alias("to")), "pointers")

    def cuts(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        sums, out = np.sort(left.column("before").to_numpy()), []
        at = int(np.searchsorted(sums, right.column("entry")[0].as_py())) if right.num_rows else len(sums)
        while at < len(sums):
            out.append(int(sums[at]))
            at = int(np.searchsorted(sums, sums[at] + max_bytes))
        return pa.table({"before": pa.array(out, pa.int64())})

    entered = visited.join(leaps.select("entry", F.col("part").alias("of")), "entry")
    found = places.select("part", "before").groupBy("part").cogroup(entered.groupBy("of")).applyInArrow(cuts, "before bigint")
    starts = lookup_join(places.select("before", "at"), written(found, "cuts"), ["before"], "left_semi", hot=[])
    shard = (F.row_number().over(Window.orderBy("before")) - 1).cast("bigint")  # a row per shard
    return starts.select(shard.alias("shard"), "before", *[F.col(f"at.{c}").alias(c) for c in order])


def rollover_greedy(df: DataFrame, max_bytes: int = ROLLOVER_BYTES, order: Sequence[str] = ("ts", "capture_id")) -> DataFrame:
    """Adds ``shard``, numbered as a writer fills its files one after the other (see
    :func:`shard_starts`).  Rows stay where they are: each looks up its hour in a small
    table of the shards that start in it.  A size of null is 0; rows without a time
    come first.  ``order`` is a timestamp and a unique id."""
    ts, uid = order
    starts = written(shard_starts(df, max_bytes, order), "shard-starts")
    cell = F.struct(F.date_trunc("hour", F.col(ts).cast("timestamp")).alias("hour")).alias("shard_cell")
    inside = starts.groupBy(cell).agg(F.sort_array(F.collect_list(F.struct(ts, uid))).alias("shard_inside"))
    hours = df.select(cell).distinct().join(inside, "shard_cell", "left")
    earlier = F.sum(F.coalesce(F.size("shard_inside"), F.lit(0))).over(Window.orderBy("shard_cell").rowsBetween(Window.unboundedPreceding, -1))
    hours = written(hours.select("shard_cell", "shard_inside", F.coalesce(earlier, F.lit(0)).alias("shard_base")), "shard-hours")
    placed = lookup_join(df.withColumn("shard_cell", cell), hours, ["shard_cell"], spread=[uid])
    begun = F.size(F.filter(F.coalesce("shard_inside", F.array().cast(hours.schema["shard_inside"].dataType)), lambda s: s <= F.struct(ts, uid)))
    return placed.withColumn("shard", (F.col("shard_base") + begun - 1).cast("bigint")).select(*df.columns, "shard")


def compact(
    df: DataFrame, target_files: int, order: Sequence[str] = ("ts", "capture_id"), info: dict[str, str] | None = None
) -> DataFrame:
    """Rows of many archives laid out for ``target_files`` even, ordered files,
    with provenance and ``info`` columns."""
    fields = {"provenance": provenance(), **(info or {})}
    return df.withColumns({k: F.lit(v) for k, v in fields.items()}).repartitionByRange(target_files, *order)


def compact_files(spark: SparkSession, paths: Sequence[str], out: str, target_bytes: int = ROLLOVER_BYTES, info: dict[str, str] | None = None) -> None:
    """Combine Parquet files by their sizes: files are packed, largest first, into
    tasks of up to ``target_bytes``, and each task writes one file.  No row is shuffled
    and no file is read for the plan; a file beyond the size is split at row groups."""
    settings = {
        "spark.sql.files.maxPartitionBytes": str(target_bytes),
        "spark.sql.files.openCostInBytes": "0",
        "spark.sql.files.minPartitionNum": "1",
        "spark.sql.files.maxPartitionNum": None,
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    fields = {"provenance": provenance(), **(info or {})}

    def put(values: dict[str, str | None]) -> None:
        for key, value in values.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)

    put(settings)
    try:
        spark.read.parquet(*paths).withColumns({k: F.lit(v) for k, v in fields.items()}).write.parquet(out)
    finally:
        put(before)


def page_text(pages: DataFrame) -> DataFrame:
    """(url, text) per page, in one stage."""
    return pages.select("url", H.text_of(F.col("html")).alias("text"))


def write_page_list(pages: DataFrame, path: str, overwrite: bool = False) -> None:
    """Page texts as JSON lines."""
    check_target(pages.sparkSession, path, overwrite)
    page_text(pages).write.mode("overwrite" if overwrite else "errorifexists").json(path)
