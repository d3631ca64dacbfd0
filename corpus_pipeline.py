"""From raw documents to token ids: quality, copies, near copies, mixing, tokens."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandline.llm import bpe_transducer, exact_dedup, mixing, near_copies, ordinal_quality, simhash
from strandline.session import written

MEMO = 120_000  # stretches a worker keeps: the other stages' models are in its memory too
BATCH = 1_000  # whole texts that Spark hands to a worker at a time: in its memory and in the executor's

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, trained on the labels, does not reject."""
    return ordinal_quality.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: by fingerprint, which thins out large
    groups, then by shingles, which finds all that are left.  No documents give none."""
    return near_copies.drop_similar(docs, among=simhash.representatives(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row of the mix, the number and digests of its token ids."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    return bpe_transducer.encode_decode(docs, path, public_tokenizers.PATTERN, keep=("doc_id", "source"), memo=MEMO)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mixed),
    ("bpe_tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Word order, hashing and tokens go beyond SQL over whole tables.
ORACLE_SQL = None
