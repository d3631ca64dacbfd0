"""Source mixing against the same mix by plain loops."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from strandline.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, size string, mix_size string, target string"


def by_loops(rows):
    size = lambda t: len(re.findall("[^ \t-\r]+", t or ""))
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s))
    total = {s: sum(size(r[1]) for r in rows if r[2] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, left, full = {}, 1.5 * sum(total.values()), set()
    while True:
        open_weight = sum(weight[s] for s in sources if s not in full)
        level = left / open_weight if open_weight else 0
        above = {s for s in sources if s not in full and 2 * total[s] <= level * weight[s]}
        if not above:
            break
        full |= above
        left -= sum(2 * total[s] for s in above)
    target = {s: 2.0 * total[s] if s in full else level * weight[s] for s in sources}
    out = []
    for s in sources:
        keyed = []
        for doc_id, text, source, *_ in rows:
            if source == s:
                n = size(text)
                name = ":".join(x for x in (None if doc_id is None else str(doc_id), md5(text or "")) if x is not None)
                u = (int(md5(name)[:13], 16) + 0.5) / 2**52
                worth = 1.0 if text is None else 1 / (1 + abs(len(text) / max(n, 1) - 6))
                keyed.append((-math.log(u) / worth, doc_id or 0, n, doc_id))
        epochs, before = int(target[s] // total[s]) if total[s] else 0, 0
        for _, _, n, doc_id in sorted(keyed, key=lambda k: k[:3]):
            more = before + n / 2 <= target[s] - epochs * total[s]
            before += n
            out.append((doc_id, n, total[s], pytest.approx(target[s]), n * (epochs + more)))
    return out


def mixed(docs):
    columns = ["doc_id", "mix_size", "mix_source_size", "mix_target", F.col("mix_size") * F.col("mix_copies")]
    return sorted(map(tuple, mixing.mix(docs).select(*columns).collect()), key=lambda r: (repr(r[0]), r[1:]))


@pytest.mark.parametrize("ranges", [2_000, 7])
def test_as_by_loops(spark, monkeypatch, ranges):
    monkeypatch.setattr(mixing, "RANGE_ROWS", ranges)
    rng = random.Random(3)
    names = [None, "", "b", "a", "é", "Z", "hot"]
    rows = [(i, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 60))), rng.choice(names + ["hot"] * 5), "1", None, None) for i in range(400)]
    rows += [(900, None, "empty", None, None, None), (901, " \t\n", "empty", None, None, None), (902, "w " * 40_000, None, None, None, None)]
    rows += [(7, "again and again", "b", None, None, None)] * 3 + [(None, "no id", "b", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = mixed(docs)
    want = sorted(by_loops(rows), key=lambda r: (repr(r[0]), r[1], r[2], r[4]))
    assert [r[:3] + r[4:] for r in found] == [r[:3] + r[4:] for r in want]
    assert all(a[3] == b[3] for a, b in zip(found, want))
    assert mixed(docs.repartition(3)) == found
    again = mixing.repeated(docs)
    assert again.columns == docs.columns
    copies = {}
    for row in again.collect():
        copies[row.doc_id] = copies.get(row.doc_id, 0) + len(re.findall("[^ \t-\r]+", row.text or ""))
    for doc_id, n, _, _, taken in found:
        if doc_id not in (7, None):
            assert copies.get(doc_id, 0) == taken <= 2 * n


def test_only_dataframe_functions(spark):
    docs = spark.createDataFrame([(1, "a b", "x", None, None, None)], SCHEMA)
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_targets_share_the_excess_anew(spark):
    sources = spark.createDataFrame([("a", 10, 3.0), ("b", 1000, 1.0), ("c", 30, 2.0), ("d", 0, 3.0)], "s string, source_size bigint, weight double")
    found = {r.s: r.target for r in mixing.targets(sources).collect()}
    assert found == {"a": 20.0, "b": 1480.0, "c": 60.0, "d": 0.0}
    assert {r.s: r.target for r in mixing.targets(sources, share=3.0).collect()} == {"a": 20.0, "b": 2000.0, "c": 60.0, "d": 0.0}


def test_no_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(docs).collect() == [] and mixing.repeated(docs).collect() == []
