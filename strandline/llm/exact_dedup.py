"""Exact deduplication by a 128-bit content hash, with the bytes compared.

Rows are grouped by the MD5 of their normalised text (all white space of
``[\\x20\\x09-\\x0D]`` deleted).  Only hashes, ids and lengths are shuffled for
that.  The texts of groups of two or more are then read once more and compared:
a group whose smallest and largest text differ is a collision and is regrouped
by the texts themselves.  The comparison keeps one text per hash and task before
its shuffle, so a hot group is no hot task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.skew import hot_in, lookup_join
from strandline.session import written

SPACE = "[ \\t-\\r]+"  # \x20 and \x09 to \x0D


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def md5_binary(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _members(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(text).alias("norm"), F.char_length(text).alias("chars"))
    return rows.withColumn("h", digest(F.col("norm")))


def _groups(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per group: its size, and the row that stays (most code points,
    then smallest id with null last, then first stored)."""
    best = F.min(F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("best")
    grouped = rows.groupBy(*keys).agg(F.count("*").alias("group_size"), best)
    return grouped.select(*keys, "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid"))


def _judged(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    hot = hot_in(groups, keys, "group_size")
    joined = lookup_join(rows, groups, keys, spread=["rid"], measure=False, hot=hot)
    return joined.withColumn("kept", F.col("rid") == F.col("keep_rid"))


def collisions(docs: DataFrame, repeated: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """Hashes among ``repeated`` (column h) that stand for two or more texts."""
    texts = lookup_join(_members(docs, id_col, text_col, digest).select("h", "norm"), repeated, ["h"], "left_semi", spread=["norm"])
    ends = texts.groupBy("h").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
    return ends.filter("lo <> hi").select("h")


def dedup_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = md5_binary
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept,
    text_sha256, and the content hash ``h`` and length ``chars``.

    Texts are equal when identical after all white space is deleted; null is the
    empty text.  Exactly one row of a group is kept: most code points in the
    original, then smallest id (null last), then any one of repeated rows.  No
    rows give no rows; other columns of ``docs`` are not looked at.
    """
    sha = F.unhex(F.sha2(F.col("norm"), 256)).alias("sha")
    thin = _members(docs, id_col, text_col, digest).select(
        "doc_id", "h", "chars", sha, F.monotonically_increasing_id().alias("rid")
    )
    thin = written(thin, "dedup-rows")
    groups = written(_groups(thin, "h"), "dedup-groups")
    odd = written(collisions(docs, groups.filter("group_size > 1").select("h"), id_col, text_col, digest), "dedup-collisions")
    if odd.isEmpty():
        result = _judged(thin, groups, ["h"])
    else:
        alike = _judged(thin.join(odd, "h", "left_anti"), groups, ["h"])
        mixed = _members(docs, id_col, text_col, digest).join(odd, "h", "left_semi")
        mixed = mixed.withColumn("sha", F.unhex(F.sha2("norm", 256))).withColumn("rid", F.monotonically_increasing_id())
        mixed = written(mixed, "dedup-mixed")  # rare: only rows whose hash stands for several texts
        split = _judged(mixed, written(_groups(mixed, "h", "norm"), "dedup-split"), ["h", "norm"])
        result = alike.unionByName(split.drop("norm"))
    return result.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"), "h", "chars"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without all but the kept row of each group of equal texts, in
    the columns of ``docs``, carried along whatever their names.  Rows repeated whole
    count as copies."""
    key = lambda i, h, n: F.struct(i.alias("id"), h.alias("h"), n.alias("chars")).alias("key")
    kept = dedup_groups(docs, id_col, text_col).filter("kept").select(key(F.col("doc_id"), F.col("h"), F.col("chars")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = key(F.col(id_col), md5_binary(normalised(text)), F.char_length(text))
    rows = docs.select(own, F.struct(*docs.columns).alias("row"))
    return rows.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
