"""Structured Streaming forms: progress, statistics, deduplication, limits.

All state is keyed after a partial aggregate or a salted first pass, so one
busy crawl or URL does not fill one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, BinaryType, DataType, DoubleType, FloatType, IntegralType, StructType, TimestampType

from strandline.operators.report import latest_progress, progress_updates
from strandline.operators.skew import SALTS
from strandline.session import scratch, written

CRAWL_UPDATES = "ts timestamp, crawled bigint, total bigint"
CONVERT_UPDATES = "ts timestamp, written bigint, total bigint"


def read_updates(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of JSON updates.  Broken lines come as nulls; an update without
    ``ts`` takes its file's time of change."""
    raw = spark.readStream.schema(schema).json(path)
    changed = F.col("_metadata.file_modification_time")
    return raw.withColumn("ts", F.coalesce("ts", changed))


def progress_stream(crawl: DataFrame, convert: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The newest usable update of either input, for ``complete`` mode."""
    return latest_progress(progress_updates(crawl, convert), by)


def crawl_stats_stream(
    df: DataFrame, window: str, watermark: str, slide: str | None = None, by: Sequence[str] = (), ts: str = "ts"
) -> DataFrame:
    """Crawl statistics per window, for ``append`` mode.  Needs ``failed``;
    ``ts`` is a timestamp with time zone."""
    span = F.window(ts, window, slide) if slide else F.window(ts, window)
    stats = (
        df.withWatermark(ts, watermark)
        .groupBy(span.alias("span"), *by)
        .agg(
            F.count_if(~F.col("failed")).alias("crawled"),
            F.count_if("failed").alias("failed"),
            F.count("*").alias("total"),
        )
    )
    return stats.select(F.col("span.start").alias("start"), F.col("span.end").alias("end"), *by, "crawled", "failed", "total")


def dedup_stream(df: DataFrame, key: Sequence[str], watermark: str, ts: str = "ts", spread: str = "capture_id") -> DataFrame:
    """One capture of each key within the watermark, as soon as it arrives: which
    one depends on the order of arrival.  :func:`firsts_per_window` and
    :func:`first_of_key` keep the earliest.  A first pass per (key, salt) leaves at
    most one row per salt of a hot key for the second."""
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS))
    marked = df.withWatermark(ts, watermark).withColumn("salt", salt)
    return marked.dropDuplicatesWithinWatermark([*key, "salt"]).dropDuplicatesWithinWatermark(list(key)).drop("salt")


def firsts_per_window(
    df: DataFrame, key: Sequence[str], watermark: str, window: str = "1 hour", ts: str = "ts", uid: str = "capture_id"
) -> DataFrame:
    """(key, ts, uid) of the earliest capture of each key in each closed window,
    for ``append`` mode.  A partial minimum comes before the shuffle."""
    spans = df.withWatermark(ts, watermark).groupBy(*key, F.window(ts, window).alias("span"))
    firsts = spans.agg(F.min(F.struct(F.col(ts).alias("t"), F.col(uid).alias("u"))).alias("first"))
    return firsts.select(*key, F.col("first.t").alias(ts), F.col("first.u").alias(uid))


KEY_GROUPS = 4096  # groups of keys, each with one call and one state for all its keys


def _text(column: str, kind: DataType) -> Column:
    """A key column as text: equal where grouping holds values for equal."""
    value = F.col(column)
    if isinstance(kind, (FloatType, DoubleType)):
        return F.when(value == 0, F.lit(0).cast(kind)).otherwise(value).cast("string")
    if isinstance(kind, BinaryType):
        return F.hex(value)
    if isinstance(kind, TimestampType):
        return F.unix_micros(value).cast("string")
    if isinstance(kind, (ArrayType, StructType)):
        return F.to_json(F.struct(value.alias("value")), _EXACT)
    return value.cast("string")


def _valued(column: str, kind: DataType) -> Column:
    """The value that :func:`_text` has as text."""
    text = F.col(column)
    if isinstance(kind, BinaryType):
        return F.unhex(text)
    if isinstance(kind, TimestampType):
        return F.timestamp_micros(text.cast("bigint"))
    if isinstance(kind, (ArrayType, StructType)):
        return F.from_json(text, StructType().add("value", kind), _EXACT)["value"]
    return text.cast(kind)


_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def first_of_key(
    firsts: DataFrame, key: Sequence[str], horizon: str = "30 days", ts: str = "ts", uid: str = "capture_id", groups: int = KEY_GROUPS
) -> DataFrame:
    """The earliest capture of each key, once; a key not seen for ``horizon`` is
    forgotten, which bounds the state.

    ``firsts`` is a stream over the table that :func:`firsts_per_window` fills: one
    row per key and window, and windows close in order, so the first row of a key
    is its earliest.  Keys are handled in ``groups`` by their hash, as a call and a
    state for each key cost more than all the rest; a group's state lists its keys and
    until when each is known.  A stream that goes on must keep to its ``groups``."""
    columns = [*key, ts, uid]
    schema = firsts.select(*columns).schema
    keep_ms = int(pd.Timedelta(horizon).total_seconds() * 1000)
    names = [f"key_{i}" for i in range(len(key))]
    whole = isinstance(schema[uid].dataType, IntegralType)  # which pandas keeps as floats beside a null
    uid_kind = "decimal(20,0)" if whole else schema[uid].dataType.simpleString()

    def place(row: tuple) -> tuple:
        """Rows in order of time and id, those without an id last."""
        return row[0], row[1] is None or row[1] != row[1], row[1]

    def watch(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *known, until = state.get if state.exists else [[] for _ in [*names, ts]]
        seen = dict(zip(zip(*known), until))
        now = state.getCurrentWatermarkMs()
        first: dict[tuple, tuple] = {}
        last: dict[tuple, pd.Timestamp] = {}
        if not state.hasTimedOut:
            for frame in frames:
                for row in zip(zip(*(frame[n].tolist() for n in names)), frame["first_ts"].tolist(), frame["first_uid"].tolist()):
                    name, found = row[0], row[1:]
                    if name not in seen and (name not in first or place(found) < place(first[name])):
                        first[name] = found
                    if name not in last or found[0] > last[name]:
                        last[name] = found[0]
        seen = {name: end for name, end in seen.items() if end >= now or name in last}
        seen.update((name, max(int(t.timestamp() * 1000), now) + keep_ms) for name, t in last.items())
        if seen:
            state.update((*map(list, zip(*seen)), list(seen.values())))
            state.setTimeoutTimestamp(min(seen.values()))
        else:
            state.remove()
        if first:
            found = {n: list(values) for n, values in zip(names, zip(*first))}
            yield pd.DataFrame(found | {"first_ts": [t for t, _ in first.values()], "first_uid": [u for _, u in first.values()]})

    rows = firsts.select(*columns).withWatermark(ts, "0 seconds")
    texts = [_text(k, schema[k].dataType).alias(n) for k, n in zip(key, names)]
    rows = rows.select(F.pmod(F.xxhash64(*texts), F.lit(groups)).alias("key_group"), *texts, F.col(ts).alias("first_ts"), F.col(uid).cast(uid_kind).alias("first_uid"))
    out = ", ".join([*(f"{n} string" for n in names), f"first_ts {schema[ts].dataType.simpleString()}", f"first_uid {uid_kind}"])
    kept = ", ".join([*(f"{n} array<string>" for n in names), "until array<bigint>"])
    found = rows.groupBy("key_group").applyInPandasWithState(watch, out, kept, "append", GroupStateTimeout.EventTimeTimeout)
    values = [_valued(n, schema[k].dataType).alias(k) for k, n in zip(key, names)]
    return found.select(*values, F.col("first_ts").alias(ts), F.col("first_uid").cast(schema[uid].dataType).alias(uid))


class FirstCaptures:
    """The earliest capture of each key, merged batch by batch into a table at ``path``
    that is bucketed on the key, so what is known is read without a shuffle.

    A batch writes its own part of the table: the keys that are new, or now earlier.
    When it is replayed it looks only at the batches before it and overwrites its part.
    Captures may come in any order; null keys are one key.  After ``fold_after``
    batches the parts are folded into one of a negative number; the minimum is the same
    whether or not the parts that it replaces are still there."""

    def __init__(self, spark: SparkSession, schema: StructType, key: Sequence[str], path: str, ts: str = "ts", uid: str = "capture_id", buckets: int = 64, fold_after: int = 64):
        self.spark, self.key, self.path, self.ts, self.uid, self.fold_after = spark, list(key), path, ts, uid, fold_after
        self.name = "first_" + uuid4().hex
        columns = ", ".join(f"`{c}` {schema[c].dataType.simpleString()}" for c in (*key, ts, uid))
        clustered = ", ".join(f"`{c}`" for c in key)
        spark.sql(
            f"CREATE TABLE {self.name} ({columns}, batch BIGINT) USING parquet PARTITIONED BY (batch)"
            f" CLUSTERED BY ({clustered}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
        spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")  # of a run before

    def _firsts(self, df: DataFrame) -> DataFrame:
        return df.groupBy(*self.key).agg(F.min(F.struct(F.col(self.ts).alias("t"), F.col(self.uid).alias("u"))).alias("first"))

    def _write(self, firsts: DataFrame, part: int) -> None:
        rows = firsts.select(*self.key, F.col("first.t").alias(self.ts), F.col("first.u").alias(self.uid))
        rows = written(rows, "firsts")  # a table is not overwritten while it is read
        view = "rows_" + uuid4().hex
        rows.createOrReplaceTempView(view)
        session = rows.sparkSession
        session.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (batch = {part}) SELECT * FROM {view}")
        session.catalog.dropTempView(view)

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``."""
        known = self._firsts(batch.sparkSession.table(self.name).filter(F.col("batch") < batch_id)).withColumnRenamed("first", "known")
        both = self._firsts(batch).join(known, self.key, "left")
        self._write(both.filter("known is null or first < known"), batch_id)
        parts = [r.batch for r in self.parts()]
        if len([p for p in parts if p < batch_id]) > self.fold_after:
            self.fold(batch_id - 1)

    def parts(self) -> list:
        listed = self.spark.sql(f"SHOW PARTITIONS {self.name}")  # one a batch since the last fold
        return listed.select(F.regexp_extract("partition", "batch=(-?[0-9]+)", 1).cast("bigint").alias("batch")).collect()

    def fold(self, upto: int) -> None:
        """One part for all up to a batch that will not come again."""
        old = [r.batch for r in self.parts() if r.batch <= upto]
        folded = -2 - upto
        if folded in old:
            return
        self._write(self._firsts(self.spark.table(self.name).filter(F.col("batch") <= upto)), folded)
        for part in old:
            self.spark.sql(f"ALTER TABLE {self.name} DROP PARTITION (batch = {part})")
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={part}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def read(self) -> DataFrame:
        """(key, ts, uid) of the earliest capture of each key so far."""
        return self._firsts(self.spark.table(self.name)).select(*self.key, F.col("first.t").alias(self.ts), F.col("first.u").alias(self.uid))

    def run(self, stream: DataFrame) -> DataFrame:
        """Merge what is there and stop."""
        writer = stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", self.path + "-state")
        writer.trigger(availableNow=True).start().awaitTermination()
        return self.read()


def bytes_per_window(
    df: DataFrame, watermark: str, window: str = "1 minute", by: str = "collection", ts: str = "ts"
) -> DataFrame:
    """(by, end, bytes) of each closed window, for ``append`` mode."""
    spans = df.withWatermark(ts, watermark).groupBy(by, F.window(ts, window).alias("span"))
    return spans.agg(F.sum("bytes").alias("bytes")).select(by, F.col("span.end").alias("end"), "bytes")


def limit_monitor(sums: DataFrame, limit: int, by: str = "collection") -> DataFrame:
    """(by, end, bytes so far): once for each crawl that exceeds ``limit``.

    ``sums`` is a stream over the table that :func:`bytes_per_window` fills, so
    this step sees one row per crawl and window however busy the crawl is; its
    state is two numbers."""

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, reported = state.get if state.exists else (0, False)
        rows = pd.concat(list(frames)).sort_values("end", ignore_index=True)
        sums = total + rows["bytes"].cumsum()
        over = sums > limit
        if over.any() and not reported:
            first = int(over.idxmax())
            yield pd.DataFrame({by: [key[0]], "end": [rows["end"][first]], "bytes": [int(sums[first])]})
            reported = True
        state.update((int(sums.iloc[-1]), bool(reported)))

    return sums.groupBy(by).applyInPandasWithState(
        watch, f"{by} string, end timestamp, bytes bigint", "total bigint, reported boolean", "append", GroupStateTimeout.NoTimeout
    )


def run(stream: DataFrame, label: str) -> str:
    """Process what is there and stop.  The rows go to files in the shared
    folder; the path comes back, for a batch read or the next stream."""
    path = scratch(stream.sparkSession, label)
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", path + "-state")
        .option("path", path)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return path


def run_to_table(stream: DataFrame, label: str) -> DataFrame:
    return stream.sparkSession.read.schema(stream.schema).parquet(run(stream, label))
