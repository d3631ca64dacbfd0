"""Rows chosen by their place in the files they come from.

A decision taken on a few thin columns is brought back to whole rows without moving
them: per input file and block of 32,768 rows a bitmap (4 KiB) says which rows are
meant, and the scan of the whole rows tests it.  Only bitmaps are shuffled, and they
are broadcast in groups of files that stay within the broadcast bound."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import skew

BLOCK = 32_768  # fixed value: the rows a bitmap of Spark's aggregate holds
BITMAP_BYTES = BLOCK // 8
FILE, AT = "row_file", "row_at"


def _scanned(df: DataFrame) -> bool:
    """Is each row one row of a file?  Only projections and filters keep that."""
    node = df._jdf.queryExecution().analyzed()
    while node.children().size():
        if node.nodeName() not in ("Project", "Filter", "SubqueryAlias"):
            return False
        node = node.children().apply(0)
    return node.nodeName().startswith(("LogicalRelation", "Relation"))


def located(df: DataFrame) -> DataFrame | None:
    """``df`` with the file and place of each row; None if its rows are not those of
    Parquet files, filtered or with other columns at most."""
    if not _scanned(df):
        return None
    try:
        found = df.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(AT))
    except AnalysisException:
        return None
    return None if {FILE, AT} & set(df.columns) else found


def bitmaps(rows: DataFrame, **flags: Column) -> DataFrame:
    """Per file and block, a bitmap for each condition.  ``rows`` has the places."""
    each = rows.select(FILE, F.expr(f"{AT} div {BLOCK}").alias("row_block"), (F.col(AT) % BLOCK).alias("row_bit"), *[c.alias(n) for n, c in flags.items()])
    built = [F.bitmap_construct_agg(F.when(F.col(n), F.col("row_bit"))).alias(n) for n in flags]
    return each.groupBy(FILE, "row_block").agg(*built)


def marked(bits: str) -> Column:
    """Is the row's bit set in the bitmap of its block?  No bitmap marks nothing."""
    byte = f"cast(conv(hex(substring(`{bits}`, cast({AT} % {BLOCK} div 8 as int) + 1, 1)), 16, 10) as int)"
    return F.coalesce(F.expr(f"shiftright({byte}, cast({AT} % 8 as int)) & 1") == 1, F.lit(False))


def selected(df: DataFrame, marks: DataFrame, keep: str) -> Iterator[DataFrame]:
    """The rows of ``df`` (located) whose ``keep`` bit is set, with the other bitmaps
    as booleans of their names.  One part per group of files: each part's bitmaps fit
    a broadcast, whatever the number of files.  ``marks`` is stored."""
    flags = [c for c in marks.columns if c not in (FILE, "row_block")]
    size = marks.count() * (BITMAP_BYTES * len(flags) + 256)
    groups = max(1, -(-size // skew.BROADCAST_BYTES))
    for group in range(groups):
        here = marks.filter(F.pmod(F.xxhash64(FILE), F.lit(groups)) == group) if groups > 1 else marks
        rows = df.withColumn("row_block", F.expr(f"{AT} div {BLOCK}")).join(F.broadcast(here), [FILE, "row_block"])
        rows = rows.filter(marked(keep))
        yield rows.withColumns({f: marked(f) for f in flags if f != keep}).drop(keep, "row_block", FILE, AT)
