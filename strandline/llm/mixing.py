"""Mixing sources to target weights, by weighted sampling without replacement.

A document's key is an exponential variate divided by its quality weight
(Efraimidis and Spirakis).  Each source is read in key order: complete epochs
first, then the documents whose sizes, summed in key order, fill what is left of
the source's token target.  Only DataFrame functions are used.

A hot source is never one task.  Its keys are cut into ranges of about
``RANGE_ROWS`` documents; totals per range show in which one the target is
reached, and only that range is put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.ordered import prefix_sum
from strandline.operators.skew import hot_in, lookup_join
from strandline.session import written

WORDS = "[^ \\t-\\r]+"
SHARE = 1.5  # size of the mix, as a share of all sizes
EPOCHS = 2  # no document is taken more often
WEIGHTS = (3.0, 1.0, 2.0)  # of sources by code point, repeating
RANGE_ROWS = 2_000
KEY = ["mix_none", "mix_source"]  # the source, safe for nulls


def uniform(id_col: str, text_col: str) -> Column:
    """A number in (0, 1) from id and text, the same in every run."""
    digest = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def plausibility() -> Column:
    """Quality weight in (0, 1]: 1 at six characters a word, less the further off."""
    mean = F.col("mix_chars") / F.greatest(F.col("mix_size"), F.lit(1))
    return F.coalesce(1 / (1 + F.abs(mean - 6)), F.lit(1.0))


def targets(sources: DataFrame, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Adds ``target``.  ``sources`` has ``source_size`` and ``weight``, one row
    per source.  What exceeds ``epochs`` times a source's size is shared anew by
    weight among the others, until none is above."""
    total = float(share * (sources.agg(F.sum("source_size")).first()[0] or 0))
    cap = F.col("source_size") * float(epochs)
    level, before = 0.0, -1.0
    while level > before:  # each round full sources leave, and the level of the others rises
        full = cap <= F.lit(level) * F.col("weight")
        spent, open_weight = sources.agg(
            F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))
        ).first()
        if not open_weight:
            return sources.withColumn("target", cap)
        before, level = level, (total - spent) / open_weight
    return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def _taken(
    docs: DataFrame,
    keep: Sequence[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: Column | None = None,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    epochs: int = EPOCHS,
) -> DataFrame:
    """mix_kept (the ``keep`` columns as a struct, so that no names clash),
    mix_size, mix_source_size, mix_target, mix_copies."""
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORDS)), F.lit(0)).cast("bigint")
    rows = docs.select(
        F.struct(*keep).alias("mix_kept"),
        F.col(source_col).isNull().alias("mix_none"),
        F.coalesce(F.col(source_col), F.lit("")).alias("mix_source"),
        size.alias("mix_size"),
        F.col(id_col).alias("mix_id"),
        F.char_length(F.col(text_col)).alias("mix_chars"),
        uniform(id_col, text_col).alias("mix_u"),
        *([] if quality is None else [quality.alias("mix_quality")]),
    )
    worth = plausibility() if quality is None else F.col("mix_quality")
    rows = rows.withColumn("mix_worth", worth).withColumn("mix_key", -F.log("mix_u") / F.col("mix_worth"))
    rows = rows.drop("mix_chars", "mix_quality", "mix_u")
    rows = written(rows.withColumn("mix_rid", F.monotonically_increasing_id()), "mix-rows")

    plan = written(_plan(rows.drop("mix_kept"), weights, share, epochs), "mix-plan")
    hot = hot_in(plan.select(*KEY, "mix_rows"), KEY, "mix_rows")
    wanted = [*KEY, "mix_source_size", "mix_target", "mix_full", "mix_edge", "mix_ranges", "mix_rate", "mix_last"]
    taken = lookup_join(rows, plan.select(*wanted), KEY, spread=["mix_rid"], hot=hot)
    at = _range(F.col("mix_key"), F.col("mix_rate"), F.col("mix_ranges"))
    order = F.struct("mix_key", "mix_id", "mix_size", "mix_rid")
    more = (at < F.col("mix_edge")) | ((at == F.col("mix_edge")) & (order <= F.col("mix_last")))
    copies = F.col("mix_full") + F.coalesce(more, F.lit(False)).cast("bigint")
    return taken.select("mix_kept", "mix_size", "mix_source_size", "mix_target", copies.alias("mix_copies"))


def mix(docs: DataFrame, keep: Sequence[str] = ("doc_id",), **options) -> DataFrame:
    """The ``keep`` columns of every row of ``docs`` and mix_size, mix_source_size,
    mix_target and mix_copies: how often the mix takes the row.

    Size is the number of words ``[^\\x20\\x09-\\x0D]+``; null and empty texts have
    0 and are never short of their target.  A null source is a source of its own,
    last in order.  The document in which the target falls is taken if at least
    half of it is below, so a source is off by half a document at most.  Rows equal
    in id and text are interchangeable; each counts.  ``quality`` (default: a
    plausible mean word length) must be in (0, 1].  No rows give no rows.  Other
    options: the columns' names, weights, share and epochs.
    """
    return _taken(docs, keep, **options).select("mix_kept.*", "mix_size", "mix_source_size", "mix_target", "mix_copies")


def _range(key: Column, rate: Column, ranges: Column) -> Column:
    """Which of the ranges, about alike in rows, an exponential key falls in."""
    return F.least(F.floor((1 - F.exp(-key * rate)) * ranges), ranges - 1)


def _plan(rows: DataFrame, weights: Sequence[float], share: float, epochs: int) -> DataFrame:
    """One row per source: complete epochs, and up to where the next one goes
    (all ranges below ``mix_edge``, and in that range all keys to ``mix_last``)."""
    sources = rows.groupBy(*KEY).agg(
        F.sum("mix_size").alias("source_size"),
        F.count("*").alias("mix_rows"),
        F.avg("mix_worth").alias("mix_rate"),
    )
    sources = written(sources, "mix-sources")
    ranked = prefix_sum(sources.withColumn("one", F.lit(1).cast("bigint")), "one", KEY)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("before") % len(weights) + 1).cast("int"))
    planned = targets(ranked.withColumn("weight", weight).drop("one", "before"), share, epochs)
    full = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
    planned = planned.select(
        *KEY, "mix_rows", "mix_rate",
        F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"),
        full.alias("mix_full"),
        (F.col("target") - full * F.col("source_size")).alias("mix_rest"),
        F.ceil(F.col("mix_rows") / RANGE_ROWS).alias("mix_ranges"),
    )
    planned = written(planned, "mix-targets")

    hot = hot_in(planned.select(*KEY, "mix_rows"), KEY, "mix_rows")
    placed = lookup_join(rows.drop("mix_rows"), planned.select(*KEY, "mix_rate", "mix_ranges", "mix_rest"), KEY, spread=["mix_rid"], hot=hot)
    placed = placed.withColumn("mix_at", _range(F.col("mix_key"), F.col("mix_rate"), F.col("mix_ranges")))
    totals = placed.groupBy(*KEY, "mix_at").agg(F.sum("mix_size").alias("here"), F.first("mix_rest").alias("rest"))
    earlier = F.sum("here").over(Window.partitionBy(*KEY).orderBy("mix_at").rowsBetween(Window.unboundedPreceding, -1))
    edges = totals.withColumn("below", F.coalesce(earlier, F.lit(0)))
    edges = edges.filter((F.col("below") <= F.col("rest")) & (F.col("below") + F.col("here") > F.col("rest")))
    edges = written(edges.select(*KEY, F.col("mix_at").alias("mix_edge"), "below"), "mix-edges")  # at most one a source

    inside = lookup_join(placed, edges.withColumnRenamed("mix_edge", "mix_at"), [*KEY, "mix_at"], spread=["mix_rid"], hot=[])
    by_key = Window.partitionBy(*KEY).orderBy("mix_key", "mix_id", "mix_size", "mix_rid")
    sum_before = F.coalesce(F.sum("mix_size").over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = inside.withColumn("middle", F.col("below") + sum_before + F.col("mix_size") / 2).filter("middle <= mix_rest")
    last = chosen.groupBy(*KEY).agg(F.max(F.struct("mix_key", "mix_id", "mix_size", "mix_rid")).alias("mix_last"))
    return planned.join(edges.drop("below"), KEY, "left").join(last, KEY, "left")


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are taken."""
    taken = _taken(docs, docs.columns, **options).filter("mix_copies > 0")
    each = F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))).alias("mix_copy")
    return taken.select("mix_kept", each).select("mix_kept.*")
