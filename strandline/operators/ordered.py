"""Running sums over a global order, without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.skew import lookup_join
from strandline.session import BucketedTable, shuffle_partitions, written


def _earlier(value: str, window) -> Column:
    total = F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(total, F.lit(0).cast("bigint"))


def prefix_sum(df: DataFrame, value: str, order: Sequence[str], per: Sequence[str] = ()) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over all earlier rows (of the same
    ``per`` group; null is a group).  Nulls come first in the order.

    One range shuffle puts the rows in order.  The result is stored bucketed on
    the partition number, so the per-partition totals and the running sums that
    follow read it in place.  Ranges cut through groups and equal timestamps
    (``order`` ends in a unique id), so no group lands in one task.  All columns
    of ``df`` are stored: give it the order, the groups and the value only.
    """
    spark, per, order = df.sparkSession, list(per), list(order)
    table = BucketedTable(spark, "prefix", ("pid",), shuffle_partitions(spark))
    try:
        ordered = df.repartitionByRange(*per, *order).withColumn("pid", F.spark_partition_id())
        stored = table.add(ordered, spread=False).read().withColumn("per_group", F.struct("pid", *per))

        totals = stored.groupBy("per_group", "pid", *per).agg(F.sum(value).cast("bigint").alias("part_total"))
        earlier = _earlier("part_total", Window.partitionBy(*per).orderBy("pid"))
        offsets = totals.select("per_group", earlier.alias("offset"))
        if not per:  # one row per partition
            offsets = F.broadcast(offsets)
        inside = stored.withColumn("inside", _earlier(value, Window.partitionBy("pid", *per).orderBy(*order)))
        result = inside.join(offsets, "per_group").withColumn("before", F.col("offset") + F.col("inside"))
        return result.select(*df.columns, "before")
    finally:
        table.close()


def up_to(ts: Column, uid: Column, last_ts: Column, last_uid: Column) -> Column:
    """At or before a row in the order (ts, uid), rows without ts first."""
    tied = ts.eqNullSafe(last_ts) & (uid <= last_uid)
    return tied | (ts.isNull() & last_ts.isNotNull()) | F.coalesce(ts < last_ts, F.lit(False))


def running_cut(
    df: DataFrame, value: Column, limit: int, order: Sequence[str], per: Sequence[str] = ()
) -> tuple[DataFrame, bool]:
    """Rows whose earlier rows sum to at most ``limit``, and whether any group's
    total exceeds it.  ``order`` is (timestamp, unique id); rows without timestamp
    come first, and null is a group like any other.

    Hourly totals are tiny, and show in which single hour each group crosses the
    line.  Only ids, times and values of those hours are put in exact order, to
    find the last row kept; the rest is a filter on the rows where they are.
    """
    ts, uid = order
    group = F.struct(*per).alias("cut_group") if per else F.lit(0).alias("cut_group")  # equal where both are null
    hour = F.date_trunc("hour", F.col(ts).cast("timestamp"))
    sized = df.select(group, ts, uid, hour.alias("cut_hour"), value.cast("bigint").alias("cut_value"))
    hours = sized.groupBy("cut_group", "cut_hour").agg(F.sum("cut_value").cast("bigint").alias("v"))
    earlier = _earlier("v", Window.partitionBy("cut_group").orderBy("cut_hour"))
    edge = hours.withColumn("cut_offset", earlier).filter((F.col("cut_offset") <= limit) & (F.col("cut_offset") + F.col("v") > limit))
    edge = written(edge.select("cut_group", F.struct("cut_hour").alias("at"), "cut_offset"), "edges")  # at most one a group
    if edge.isEmpty():
        return df, False

    if not per:
        row = edge.first()
        start, kind = row["at"]["cut_hour"], df.schema[ts].dataType
        if start is None:
            inside = sized.filter(F.col(ts).isNull())
        else:  # plain bounds on the column, so they reach the scan
            end = (F.lit(start) + F.expr("interval 1 hour")).cast(kind)
            inside = sized.filter((F.col(ts) >= F.lit(start).cast(kind)) & (F.col(ts) < end))
        summed = prefix_sum(inside.select(ts, uid, "cut_value"), "cut_value", order)
        last = summed.filter(F.col("before") + row["cut_offset"] <= limit).agg(F.max(F.struct(ts, uid)).alias("k"))
        last_ts, last_uid = last.select(F.col(f"k.{ts}").cast("string"), f"k.{uid}").first()
        if last_ts is None:
            return df.filter(F.col(ts).isNull() & (F.col(uid) <= F.lit(last_uid))), True
        at = F.lit(last_ts).cast(kind)
        return df.filter(F.col(ts).isNull() | (F.col(ts) < at) | ((F.col(ts) == at) & (F.col(uid) <= F.lit(last_uid)))), True

    inside = sized.withColumn("at", F.struct("cut_hour"))
    inside = lookup_join(inside, edge, ["cut_group", "at"], spread=[uid])
    summed = prefix_sum(inside.select("cut_group", ts, uid, "cut_value", "cut_offset"), "cut_value", order, ["cut_group"])
    kept = summed.filter(F.col("cut_offset") + F.col("before") <= limit)
    last = kept.groupBy("cut_group").agg(F.max(F.struct(F.col(ts).alias("t"), F.col(uid).alias("u"))).alias("cut_last"))
    last = written(last, "cuts")  # one row per group that exceeds the limit
    marked = lookup_join(df.withColumn("cut_group", group), last, ["cut_group"], "left", spread=[uid])
    within = up_to(F.col(ts), F.col(uid), F.col("cut_last.t"), F.col("cut_last.u"))
    return marked.filter(F.col("cut_last").isNull() | within).select(*df.columns), True
