"""Near copies by shingles against all pairs compared."""

import random

import numpy as np
import pytest

import corpus_pipeline
from strandline.llm import near_copies

SCHEMA = "doc_id bigint, text string, near_row_tag string"


def jaccard(a, b):
    cut = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())(t.lower().split())
    a, b = cut(a or ""), cut(b or "")
    return len(a & b) / len(a | b) if a and b else 0.0


def planted(rng, line="", groups=12, copies=3):
    """Texts with copies in which 0 to 5 runs of words are replaced, some with a common line."""
    texts = []
    for g in range(groups):
        words = [rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(rng.choice([12, 60, 200]))]
        texts.append(" ".join(words) + line)
        for _ in range(copies):
            changed = list(words)
            for _ in range(rng.randint(1, 3)):
                changed[rng.randrange(len(changed))] = "changed%d" % rng.randrange(1_000)
            texts.append(" ".join(changed) + line)
    return texts


def kept_by_loops(texts, ids):
    """Of each group that alike texts join, the smallest id."""
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, []).append(ids[i])
    return sorted(min(g) for g in groups.values())


@pytest.mark.parametrize(
    ("line", "posting", "first", "copies"), [("", 2_048, 4, 3), (" one very common line that all of them hold at their end", 2, 1, 3), ("", 3, 1, 9), ("", 16, 100, 9)]
)
def test_exact_ids_whatever_the_posting(spark, monkeypatch, line, posting, first, copies):
    monkeypatch.setattr(near_copies, "POSTING", posting)
    monkeypatch.setattr(near_copies, "FIRST", first)
    texts = planted(random.Random(7), line, copies=copies) + ["One two", "one  TWO", "a b", "", None]
    ids = random.Random(1).sample(range(1_000), len(texts))
    docs = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], SCHEMA).repartition(4)
    kept = near_copies.drop_similar(docs)
    assert kept.schema == docs.schema
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows) == kept_by_loops(texts, ids) and {r.near_row_tag for r in rows} == {"x"}


@pytest.mark.parametrize("posting", [2, 16, 1_000])
def test_chain_keeps_one(spark, monkeypatch, posting):
    """Texts of 100 words, each shifted by 5 from the one before: all one group."""
    monkeypatch.setattr(near_copies, "POSTING", posting)
    words = ["w%d" % i for i in range(300)]
    texts = [" ".join(words[5 * i : 5 * i + 100]) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    assert [r.doc_id for r in near_copies.drop_similar(docs).collect()] == [0]


def test_repeats_null_ids_and_clashing_names(spark):
    schema = "doc_id bigint, text string, key string, tag binary, row int, node string, size string"
    text = " ".join("w%d" % i for i in range(50))
    rows = [(1, text, "a", b"b", 3, "n", None), (1, text, "a", b"b", 3, "n", None), (None, text + " end", "c", None, 4, "m", "s"), (None, "alone", "d", None, 5, None, "t"), (2, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    kept = near_copies.drop_similar(docs)
    assert kept.schema == docs.schema
    assert sorted(map(repr, kept.collect())) == sorted({repr(r) for r in docs.collect() if r.text != text + " end"})


def test_bitmaps_rule_out_no_pair():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 400))
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        sets = [base]
        for _ in range(8):
            other = np.unique(np.concatenate([rng.choice(base, max(1, int(len(base) * rng.uniform(0.7, 1))), replace=False), rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 5)), dtype=np.uint64)]))
            sets.append(other)
        sets.sort(key=len)
        sizes = np.array([len(s) for s in sets])
        a, b = near_copies.near_in(sizes, [near_copies.parity(s) for s in sets], np.ones(len(sets), bool))
        found = set(zip(a.tolist(), b.tolist()))
        for i in range(len(sets)):
            for j in range(i + 1, len(sets)):
                if len(np.intersect1d(sets[i], sets[j])) * 180 >= 80 * (len(sets[i]) + len(sets[j])):
                    assert (i, j) in found


def test_first_shingles_meet_in_any_order():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n, shared = int(rng.integers(1, 40)), 0
        base = np.unique(rng.integers(0, 1 << 60, n + 12, dtype=np.uint64))
        a, b = base[: n + 5], base[rng.integers(0, 3) :]
        shared = len(np.intersect1d(a, b))
        common = np.sort(rng.choice(base, len(base) // 2, replace=False))
        if shared * 180 >= 80 * (len(a) + len(b)):
            assert len(np.intersect1d(*(near_copies.first_shingles(x, common) for x in (a, b))))


def test_pipeline_stage_drops_copies_of_four_fifths(spark):
    """Two long texts with a Jaccard similarity of 0.8 to 0.95 lie more than 3 bits apart."""
    rng = random.Random(3)
    rows = []
    for n, changes in enumerate((2, 4, 6, 8)):
        words = ["w%d" % rng.randrange(5_000) for _ in range(400)]
        changed = list(words)
        for at in rng.sample(range(20, 380), changes):
            changed[at] = "new"
        rows += [(2 * n, " ".join(words), "x"), (2 * n + 1, " ".join(changed), "x")]
        assert 0.8 <= jaccard(rows[-1][1], rows[-2][1]) <= 0.98
    kept = corpus_pipeline.near(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 4, 6]


def test_no_rows(spark):
    assert near_copies.drop_similar(spark.createDataFrame([], SCHEMA)).collect() == []
