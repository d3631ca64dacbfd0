"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import written

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 32 << 20
HOT_SHARE = 256  # a key is hot above 1/256 of the rows, so at most 255 keys are
HOT_ROWS = 500_000  # and only if it has this many rows: less fits one task
SALTS = 64


def fits_broadcast(df: DataFrame) -> bool:
    """Measure ``df`` (one pre-aggregated pass) against the broadcast bounds."""
    size = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(0))
    rows, width = df.agg(F.count("*"), F.sum(size)).first()
    return rows <= BROADCAST_ROWS and (width or 0) <= BROADCAST_BYTES


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def hot_in(counts: DataFrame, keys: Sequence[str], n: str) -> list[int]:
    """Hashes of the hot keys of a table that counts rows per key in ``n``: at
    most ``HOT_SHARE - 1`` numbers."""
    total = counts.agg(F.sum(n)).scalar()
    hot = counts.filter((F.col(n) >= HOT_ROWS) & (F.col(n) * HOT_SHARE > total))
    return [row.h for row in hot.select(key_hash(keys).alias("h")).collect()]


def hot_keys(df: DataFrame, keys: Sequence[str]) -> list[int]:
    """The same, counting first (partially before the shuffle)."""
    return hot_in(df.groupBy(*keys).agg(F.count("*").alias("row_count")), keys, "row_count")


def key_profile(df: DataFrame, keys: Sequence[str]) -> tuple[int, list[int]]:
    """Number of rows and hot keys, in one pass over ``df``."""
    counts = written(df.groupBy(*keys).agg(F.count("*").alias("row_count")), "counts")
    return counts.agg(F.sum("row_count")).first()[0] or 0, hot_in(counts, keys, "row_count")


def salted(df: DataFrame, keys: Sequence[str], hot: list[int], spread: Sequence[str]) -> DataFrame:
    """Adds ``salt``: hot keys spread over ``SALTS`` values by the ``spread``
    columns (a hash, so a re-run task gives the same value), others 0."""
    if not hot:
        return df.withColumn("salt", F.lit(0))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.lit(SALTS)).cast("int")
    return df.withColumn("salt", F.when(key_hash(keys).isin(hot), salt).otherwise(F.lit(0)))


def replicated(df: DataFrame, keys: Sequence[str], hot: list[int]) -> DataFrame:
    """The other side of :func:`salted`: one copy per salt for hot keys only."""
    if not hot:
        return df.withColumn("salt", F.lit(0))
    salts = F.when(key_hash(keys).isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return df.withColumn("salt", F.explode(salts))


def lookup_join(
    df: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] = (),
    measure: bool = True,
    hot: list[int] | None = None,
) -> DataFrame:
    """Join ``df`` to ``table``, which has at most one row per key.

    A table within the broadcast bounds is broadcast.  Beyond them (or with
    ``measure=False``, for tables known to grow with the data) both sides
    shuffle on the key, and hot keys of ``df`` (counted unless given) are
    salted by ``spread``.
    """
    on = list(on)
    if measure and fits_broadcast(table):
        return df.join(F.broadcast(table), on, how)
    hot = hot_keys(df, on) if hot is None else hot
    if not hot:
        return df.join(table, on, how)
    left = salted(df, on, hot, spread or df.columns)
    return left.join(replicated(table, on, hot), [*on, "salt"], how).drop("salt")


GROUP_LIMIT = 1_000  # up to this rank Spark trims groups before the shuffle


def first_n(df: DataFrame, per: Sequence[str], order: Sequence[Column], n: int, spread: Sequence[str]) -> DataFrame:
    """The first ``n`` rows of each group.

    For small ``n`` each task trims its groups before the shuffle.  For larger
    ones a salted pass first leaves at most ``n`` rows per salt and group."""

    def keep(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        return rows.withColumn("group_rank", rank).filter(F.col("group_rank") <= n).drop("group_rank")

    if n > GROUP_LIMIT:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.lit(SALTS))
        df = keep(df.withColumn("salt", salt), [*per, "salt"]).drop("salt")
    return keep(df, per)
