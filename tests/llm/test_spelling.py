"""Spelling variants against all pairs compared."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strandline.llm import spelling

SCHEMA = "doc_id bigint, text string, word string, n string, key string"


def near(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) - len(x) == 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def by_loops(rows, shortest=5, fewest=3):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= fewest}
    form, out = {}, {}
    for w, n in words.items():
        around = sorted((v for v in words if near(w, v)), key=lambda v: (-words[v], v))
        form[w] = around[0] if around and words[around[0]] >= 2 * n else None
        out[w] = (n, len(around), form[w], words.get(form[w]))
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] += (root,)
    return out


def documents():
    rng = random.Random(9)
    base = ["".join(rng.choice("abÉéÀ÷") for _ in range(rng.randint(4, 8))) for _ in range(40)] + ["Spelling", "variant"]
    rows = []
    for i in range(150):
        words = []
        for w in rng.choices(base, weights=range(1, len(base) + 1), k=25):
            at = rng.randrange(len(w))
            words.append(rng.choice([w, w, w, w.upper(), w[:at] + w[at + 1 :], w[:at] + "b" + w[at:], w[:at] + "a" + w[at + 1 :]]))
        rows.append((i, rng.choice([" ", ", ", "1"]).join(words), "x", "y", "z"))
    rows += [(500 + i, "chained " * 20 + "chainedd " * 6 + "chaineddd chaineddde", None, None, None) for i in range(20)]
    rows += [(1_000, None, None, None, None), (1_001, "", None, None, None), (None, "spelling " * 9, None, None, None)]
    return rows + rows[:7] + [(2_000, "verylong " * 60_000 + "verylon " * 60_000 + "x" * 300, None, None, None)]


@pytest.mark.parametrize("most", [20_000, 12])
def test_by_loops(spark, most):
    rows = documents()
    found = spelling.variants(spark.createDataFrame(rows, SCHEMA).repartition(5), most=most).collect()
    want = by_loops(rows)
    assert len(found) == len(want) > 200
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in found} == want
    assert sum(r.form is not None and r.root != r.form for r in found) >= 1


def test_lists_cut_anew_hold_every_pair(spark):
    words = sorted({"".join(random.Random(i).choices("ab", k=5 + i % 4)) for i in range(300)})
    table = spark.createDataFrame([(w, 3 + i) for i, w in enumerate(words)], "word string, n bigint")
    parts = spelling.lists(table, most=6)
    assert len(parts) > 2
    want = {w: sum(near(w, v) for v in words) for w in words}
    found = {r.word: r.n_near for r in spelling.near_words(table, most=6).collect()}
    assert found == {w: n for w, n in want.items() if n}


def test_near_pairs_of_several_lists():
    rng = random.Random(2)
    words, lists = [], []
    for number in range(30):
        part = sorted({"".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 40))})
        words += part
        lists += [number + 7] * len(part)
    codes = np.array(words).view(np.uint32).reshape(len(words), -1)
    found = [p for a, b in spelling.near_pairs(codes, np.array([len(w) for w in words]), np.array(lists)) for p in zip(a.tolist(), b.tolist())]
    want = {(i, j) for j in range(len(words)) for i in range(j) if lists[i] == lists[j] and near(words[i], words[j])}
    assert len(found) == len(set(found)) and set(found) == want


def test_counts_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 3)
    monkeypatch.setattr(spelling, "TOGETHER", 5)
    rows = documents()[:30]
    assert sum(r.n for r in spelling.vocabulary(spark.createDataFrame(rows, SCHEMA)).collect()) == sum(x[0] for x in by_loops(rows).values())


def test_no_rows(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).collect() == []
