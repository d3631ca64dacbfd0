"""Bounded samples of labelled rows for models that are fitted on the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.skew import first_n


def sampled_ids(rows: DataFrame, id_col: str, label_cols: Sequence[str], per: int) -> DataFrame:
    """The ``per`` rows of each label with the smallest hash of the id: the same
    in every run, and for small ``per`` trimmed before the shuffle.  An id that stands
    on several of them comes once, so there may be fewer."""
    thin = rows.select(id_col, *label_cols).withColumn("sample_order", F.xxhash64(F.col(id_col).cast("string"), F.lit(7)))
    order = [F.col("sample_order"), F.col(id_col)]
    return first_n(thin, list(label_cols), order, per, spread=[id_col]).drop("sample_order").dropDuplicates()


def texts_of(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One text for each row of the sample that has any: where an id stands on several
    documents, the smallest.  The sample's size is a parameter, so it is broadcast and
    the documents are filtered where they are read; each task hands on one text a row
    of the sample at most."""
    found = docs.select(id_col, text_col).join(F.broadcast(sample), id_col)
    return found.groupBy(*sample.columns).agg(F.min(text_col).alias(text_col))


def hashed_share(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """About ``most`` different rows (all, if there are fewer): those whose hash of the
    id is small enough.  The same in every run; rows that are the same count once in the
    result, so an id on many rows gives no more than its different rows."""
    total = rows.count()
    if total <= most:
        return rows.dropDuplicates()
    span = 1 << 40
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(7)), F.lit(span))
    return rows.filter(place < span * most // total).dropDuplicates()
