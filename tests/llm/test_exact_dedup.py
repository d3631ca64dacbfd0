"""Exact deduplication against grouping by the normalised text."""

import hashlib
import random

from pyspark.sql import functions as F

from strandline.llm import exact_dedup

SCHEMA = "doc_id bigint, text string, h string, norm string, kept string, chars string"


def rows_with_copies():
    rng = random.Random(1)
    texts = [None, "", " \t\n\x0b\x0c\r ", "a b", "ab", "a b", "A b", "á", "á", "x" * 200_000, "x" * 100_000 + " " + "x" * 100_000]
    texts += [" ".join(rng.choices(["a", "b", "c"], k=3)) for _ in range(40)] + ["hot  group"] * 50
    rows = [(i, t, "1", None, "z", None) for i, t in enumerate(texts)]
    rows += [(3, "a b", None, None, None, None), (None, "a b", None, None, None, None), (None, "only null id", None, None, None, None)]
    return rows + rows[-1:] + rows[4:6]


def expected(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        norm = "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(norm, []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for norm, members in groups.items():
        members.sort(key=lambda m: m[:3])
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(m[3], members[0][3], len(members), i == 0, sha) for i, m in enumerate(members)]
    return sorted(out, key=repr)


def digest(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_as_by_grouping(spark):
    rows = rows_with_copies()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert digest(exact_dedup.dedup_groups(docs)) == expected(rows)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted((d for d, _, _, kept, _ in expected(rows) if kept), key=repr)


def test_colliding_hashes_are_told_apart_by_their_bytes(spark):
    rows = rows_with_copies()
    docs = spark.createDataFrame(rows, SCHEMA)
    weak = lambda text: F.substring(F.unhex(F.md5(text)), 1, 0)  # noqa: E731  one hash for all texts
    assert digest(exact_dedup.dedup_groups(docs, digest=weak)) == expected(rows)
    part = lambda text: F.when(F.length(text) < 4, F.lit(b"")).otherwise(F.unhex(F.md5(text)))
    assert digest(exact_dedup.dedup_groups(docs, digest=part)) == expected(rows)


def test_no_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.dedup_groups(docs).collect() == []
    assert exact_dedup.drop_copies(docs).collect() == []
