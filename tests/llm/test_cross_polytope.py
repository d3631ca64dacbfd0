"""Nearest neighbours against brute force."""

import math

import numpy as np
import pytest

from strandline.llm import cross_polytope as cp

SCHEMA = "vec_id bigint, embedding array<float>, ids string, vec string, rank string"


def brute(rows, queries, k=10):
    """The k nearest by definition; rows repeated with id and vector once."""
    sound = {(i, tuple(v)) for i, v, *_ in rows if v is not None and any(v) and all(x is not None and math.isfinite(x) for x in v)}
    sizes = [len(v) for _, v in sound]
    usual = max(set(sizes), key=lambda s: (sizes.count(s), s)) if sizes else 0
    sound = sorted((s for s in sound if len(s[1]) == usual), key=lambda s: (s[0] is not None, s[0] or 0))
    x = np.array([v for _, v in sound], np.float32).astype(float).reshape(len(sound), -1)
    out = []
    for i, v in sound:
        if i in queries:
            d = np.sqrt(((x - np.array(v, np.float32).astype(float)) ** 2).sum(axis=1))
            order = [j for j in np.argsort(d, kind="stable") if sound[j][0] != i][:k]
            out += [(i, r + 1, sound[j][0], d[j]) for r, j in enumerate(order)]
    return sorted(out, key=lambda r: r[:2])


def found(spark, rows, **options):
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = cp.nearest_rows(vectors, vectors.filter("vec_id % 10 = 0"), **options)
    return sorted(map(tuple, got.collect()), key=lambda r: r[:2])


def row(i, v):
    return (i, None if v is None else [None if x is None else float(x) for x in v], None, "x", None)


def queries(rows):
    return {r[0] for r in rows if r[0] is not None and r[0] % 10 == 0}


@pytest.mark.parametrize("spread", [0.2, 3.0])
def test_recall(spark, spread):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 48))
    rows = [row(i, centres[i % 8] + spread * rng.normal(size=48)) for i in range(1_500)]
    want, got = brute(rows, queries(rows)), found(spark, rows)
    assert len(got) == len(want)
    exact = {(q, v): d for q, _, v, d in brute(rows, queries(rows), k=1_500)}
    assert all(d == pytest.approx(exact[q, v], rel=1e-12) for q, _, v, d in got)
    assert len({r[::2] for r in got} & {r[::2] for r in want}) >= 0.9 * len(want)


def test_common_vectors_ties_and_odd_rows(spark, monkeypatch):
    """A third of the rows equal, buckets in many pieces, and rows that take no part."""
    monkeypatch.setattr(cp, "PIECE", 8)
    rng = np.random.default_rng(2)
    rows = [row(i, np.ones(5)) for i in range(0, 60)] + [row(i, rng.integers(-1, 2, 5)) for i in range(60, 180)]
    rows += [row(1_000, None), row(1_010, [0] * 5), row(1_020, [1, None, 0, 0, 0]), row(1_030, [float("nan"), 1, 1, 1, 1])]
    rows += [row(1_040, [float("inf"), 1, 1, 1, 1]), row(1_050, [1, 1]), row(None, np.ones(5)), row(20, np.ones(5)), row(1_060, []), row(70, [1, 0, 0, 0, -1])]
    monkeypatch.setattr(cp, "RECALL", 1.0)
    monkeypatch.setattr(cp, "SAMPLE", 10_000)
    want, got = brute(rows, queries(rows)), found(spark, rows)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])


def test_short_answers_are_filled_exactly(spark, monkeypatch):
    """With one bucket a table visited, few rows are met; the rest are found in all buckets."""
    monkeypatch.setattr(cp, "visits_needed", lambda *a: 1)
    rng = np.random.default_rng(3)
    for count in (2, 9, 40):
        rows = [row(i, rng.normal(size=32)) for i in range(count)]
        got = found(spark, rows)
        assert [r[:2] for r in got] == [r[:2] for r in brute(rows, queries(rows))]
        if count < 12:
            assert [r[:3] for r in got] == [r[:3] for r in brute(rows, queries(rows))]


@pytest.mark.parametrize("rows", [[], [row(10, [1, 2])], [row(7, [1, 2])], [row(10, None)]])
def test_nothing_to_find(spark, rows):
    assert found(spark, rows) == []


def test_rotation_keeps_lengths_and_probes_start_at_the_bucket():
    x = np.random.default_rng(4).normal(size=(20, 13))
    assert np.allclose(np.linalg.norm(cp.rotated(x, 1, 0), axis=1), np.linalg.norm(x, axis=1))
    for axes in (1, 2, 3):
        order = cp.probes(x, 0, axes, 30)
        assert (order[:, 0] == cp.codes(x, 0, axes)).all()
        assert all(len(set(r)) == 30 for r in order.tolist())
    assert sorted(cp.probes(x[:1], 0, 1, 32)[0].tolist()) == list(range(32))
