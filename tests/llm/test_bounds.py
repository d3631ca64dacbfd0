"""What an operator holds at a time."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from strandline.llm import lm_score


def texts_of(n, length, seed):
    rng = random.Random(seed)
    texts = [b" ".join(b"%d" % int(rng.paretovariate(0.4)) for _ in range(length)) for _ in range(n)]
    numbers = list(range(n))
    return pa.RecordBatch.from_pydict({"text": texts, "target": [i % 3 == 0 for i in numbers], "tag": numbers, "tag2": numbers})


def test_a_part_is_scored_by_ranges(monkeypatch):
    monkeypatch.setattr(lm_score, "RANGE_EVENTS", 20_000, raising=False)
    batch = texts_of(300, 1_500, 3)
    rows = list(lm_score._part_rows(1)([batch]))
    found = list(lm_score._word_rows(1)([batch]))
    counts = {}
    for b in found:
        for key, target, background in zip(*(b.column(c).to_pylist() for c in ("key", "target", "background"))):
            old = counts.get(key, (0, 0))
            counts[key] = old[0] + target, old[1] + background
    n = len(counts)
    both = {"part": pa.array([0] * n, pa.int32()), "kind": pa.array([0] * n, pa.int32()), "key": list(counts), "target": [c[0] for c in counts.values()], "background": [c[1] for c in counts.values()]}
    words = pa.RecordBatch.from_pydict({**both, **{f: pa.nulls(n, pa.binary()) for f in lm_score.FIELDS}}, schema=rows[0].schema)
    events = [sum(c[i] for c in counts.values()) for i in (0, 1)]
    assert sum(events) == 300 * 1_501
    totals = lm_score.Totals(tuple(events), n - 1)
    tracemalloc.start()
    out = list(lm_score._part_sums(totals)([words, *rows]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * sum(events)
    monkeypatch.setattr(lm_score, "RANGE_EVENTS", 10**9, raising=False)
    whole = list(lm_score._part_sums(totals)([words, *rows]))
    for a, b in zip(out, whole):
        assert a.select(["lm_tag", "lm_tag2", "events", "texts"]).equals(b.select(["lm_tag", "lm_tag2", "events", "texts"]))
        assert all(np.allclose(a.column(c).to_numpy(), b.column(c).to_numpy(), rtol=1e-12) for c in ("t", "b"))
