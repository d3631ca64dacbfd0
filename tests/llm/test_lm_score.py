"""Cross-entropy differences against the definition, word by word."""

import math
import random
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import lm_score

SCHEMA = "doc_id bigint, text string, source string, lm_text string, difference string"


def by_definition(rows, word_share, pair_share):
    cut = lambda t: [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()]
    sides = {True: [], False: []}
    for _, text, source, *_ in rows:
        if cut(text):
            sides[source == "a"].append(cut(text))
    words = {s: Counter(w for d in docs for w in d) for s, docs in sides.items()}
    total = {s: sum(c.values()) for s, c in words.items()}
    listed = {w for s in sides for w, n in words[s].items() if n >= max(1, word_share * total[s])}
    name = lambda w: w if w in listed else "<unk>"
    events = {s: Counter() for s in sides}
    for s, docs in sides.items():
        for d in docs:
            seq = ["</s>", *map(name, d), "</s>"]
            events[s].update(zip(seq, seq[1:]))
    size = {s: sum(c.values()) for s, c in events.items()}
    kept = {p for s in sides for p, n in events[s].items() if n >= max(1, pair_share * size[s])}
    single = {s: Counter() for s in sides}
    before = {s: Counter() for s in sides}
    for s in sides:
        for (v, w), n in events[s].items():
            single[s][w] += n
            before[s][v] += n if (v, w) in kept else 0

    def loss(s, d):
        seq = ["</s>", *map(name, d), "</s>"]
        out = []
        for v, w in zip(seq, seq[1:]):
            p1 = (single[s][w] + 1) / (size[s] + len(listed) + 2)
            count = events[s][v, w] if (v, w) in kept else 0
            out.append(-math.log((count + lm_score.MASS * p1) / (before[s][v] + lm_score.MASS)))
        return sum(out) / len(out)

    return {r[0]: (loss(True, cut(r[1])), loss(False, cut(r[1]))) if cut(r[1]) else (None, None) for r in rows}


@pytest.mark.parametrize("shares", [(1e-9, 1e-9), (0.02, 0.01)])
def test_by_definition(spark, shares):
    rng = random.Random(2)
    words = ["The", "the", "of", "é", "x1", "..", "and", "zebra", "TO"]
    rows = [(i, " \n".join(rng.choices(words, range(9, 0, -1), k=rng.randint(1, 30))), rng.choice("abc"), "x", "y") for i in range(60)]
    rows += [(100, None, "a", None, None), (101, "", "a", None, None), (102, " \t", "b", None, None), (103, "new words", None, None, None)]
    rows += [(104, "a " * 30_000, "b", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    model = lm_score.train(docs, F.col("source") == "a", word_share=shares[0], pair_share=shares[1])
    want = by_definition(rows, *shares)
    found = lm_score.score(docs, model).collect()
    assert len(found) == len(rows)
    for row in found:
        target, background = want[row.doc_id]
        if target is None:
            assert (row.n_words, row.target_loss, row.difference) == (0, None, None)
        else:
            assert row.target_loss == pytest.approx(target) and row.background_loss == pytest.approx(background)
            assert row.difference == pytest.approx(target - background)


def test_no_rows_and_no_target(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert lm_score.score(docs, lm_score.train(docs, F.col("source") == "a")).collect() == []
    docs = spark.createDataFrame([(1, "a b", None, None, None)], SCHEMA)
    assert lm_score.score(docs, lm_score.train(docs, F.col("source") == "a")).first().n_words == 2


def test_held_counts_are_handed_on(spark, monkeypatch):
    """Counts that leave a task in many pieces sum to the same model."""
    rows = [(i, f"w{i % 7} w{i % 3} v", "ab"[i % 2], None, None) for i in range(200)]
    texts = lm_score._texts(spark.createDataFrame(rows, SCHEMA), F.col("source") == "a", "text").toArrow().to_batches()
    whole = sum((Counter(dict(zip(*map(lambda c: c.to_pylist(), b.columns[:2])))) for b in lm_score._word_counts(iter(texts))), Counter())
    monkeypatch.setattr(lm_score, "HELD", 3)
    pieces = list(lm_score._word_counts(iter(texts)))
    assert len(pieces) > 5
    assert sum((Counter(dict(zip(*map(lambda c: c.to_pylist(), b.columns[:2])))) for b in pieces), Counter()) == whole


def test_rare_words_of_a_large_text_count(spark):
    """By default no word and no bigram is cut, however many events there are."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["the", "of", "é"], k=60)) + f" rare{i} once{i}", rng.choice("ab"), "x", "y") for i in range(40)]
    rows += [(100, "a b " * 150_000, "a", None, None), (101, "c d " * 150_000, "b", None, None), (102, None, "a", None, None), (103, " ", "b", None, None)]
    rows += [(200 + i, r[1], r[2], None, None) for i, r in enumerate(rows[:5])] + [(None, rows[7][1], "a", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    model = lm_score.train(docs, F.col("source") == "a")
    want = by_definition(rows, 0, 0)
    found = lm_score.score(docs, model).collect()
    assert sorted((r.doc_id or -1, r.n_words) for r in found) == sorted((r[0] or -1, len((r[1] or "").split())) for r in rows)
    for row in found:
        for got, loss in zip((row.target_loss, row.background_loss), want[row.doc_id]):
            assert got is None if loss is None else got == pytest.approx(loss)
    new = spark.createDataFrame([(1, "the rare1 never seen", "a", None, None)], SCHEMA)
    with pytest.raises(ValueError):
        lm_score.score(docs, model, keep=("doc_id", "difference"))
    by_cut = lm_score.score(new, lm_score.train(docs, F.col("source") == "a", word_share=1e-12, pair_share=1e-12)).first()
    assert lm_score.score(new, model).first().difference == pytest.approx(by_cut.difference)


def test_many_parts_and_chunks(spark, monkeypatch):
    """Scores do not depend on how texts are gathered or bigrams spread.  Copies, a
    third of all rows, count as often as they are there."""
    rng = random.Random(9)
    words = ["the", "of", "é", *(f"w{i}" for i in range(300))]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 200))), rng.choice("abc"), None, None) for i in range(150)]
    rows += [(1000 + i, rows[3][1], "ab"[i % 2], None, None) for i in range(80)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = by_definition(rows, 0, 0)
    events = lm_score._texts(docs, F.col("source") == "a", "text").withColumns({"lm_tag": F.xxhash64("lm_text"), "lm_tag2": F.lit(1)}).toArrow().to_batches()
    whole = len(list(lm_score._chunks(iter(events))))
    monkeypatch.setattr(lm_score, "HELD", 100)
    pieces = list(lm_score._chunks(iter(events)))
    assert len(pieces) > 10 > whole and sum(int(p.times.sum()) for p in pieces) == sum(1 for r in rows if r[1])
    monkeypatch.setattr(lm_score, "EVENTS_A_PART", 500)
    for row in lm_score.score(docs, lm_score.train(docs, F.col("source") == "a")).collect():
        for got, loss in zip((row.target_loss, row.background_loss), want[row.doc_id]):
            assert got is None if loss is None else got == pytest.approx(loss)
    packed = lm_score._packed(lm_score.np.array([3, 1 << 40, -1]))
    assert lm_score._unpacked(packed, lm_score.np.int64).tolist() == [3, 1 << 40, -1]


def test_a_chunk_is_all_that_is_held_while_it_is_sorted(monkeypatch):
    """On large groups of copies an executor went over its memory in this step."""
    monkeypatch.setattr(lm_score, "HELD", 100_000)
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(800)).encode() for _ in range(490)]
    batch = pa.RecordBatch.from_pydict({"lm_text": texts, "lm_target": [i % 3 == 0 for i in range(490)], "lm_tag": range(490), "lm_tag2": range(490)})
    held = list(lm_score._chunks(iter([batch])))
    assert [len(c.word) for c in held] == [801 * 490] and (held[0].before != lm_score.EDGE).sum() == 800 * 490 == (held[0].word != lm_score.EDGE).sum()
    assert all((held[0].before[1:] == held[0].word[:-1])) and held[0].text.tolist() == [i for i in range(490) for _ in range(801)]
    words = 0
    held = None
    tracemalloc.start()
    found = lm_score._chunks(iter([batch]))
    chunk = next(found)
    words = len(chunk.word)
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    monkeypatch.setattr(lm_score, "_chunks", lambda batches: iter([chunk]))
    rows = lm_score._part_rows(4)(iter([]))
    parts = [next(rows).column("part")[0].as_py()]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert parts + [r.column("part")[0].as_py() for r in rows] == list(range(16))
    assert kept < 30 * words  # 20 bytes an event; the hashes and the memo of words were held too
    assert most - kept < 50 * words


def test_a_text_has_one_row_of_sums(spark, monkeypatch):
    """There was one for each part that a text has bigrams in, so they grew faster than the input."""
    rng = random.Random(12)
    words = ["the", "of", *(f"w{i}" for i in range(400))]
    rows = [(i, f"id{i} " + " ".join(rng.choices(words, k=150)), rng.choice("ab"), None, None) for i in range(60)]
    rows += [(100 + i, rows[0][1], "a", None, None) for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(1)
    want = by_definition(rows, 0, 0)
    made, per_text = [], lm_score._per_text
    monkeypatch.setattr(lm_score, "_per_text", lambda docs, sums, *rest: made.append(sums) or per_text(docs, sums, *rest))
    for events, slices in ((1_000, 256), (100, 2)):
        monkeypatch.setattr(lm_score, "EVENTS_A_PART", events)
        monkeypatch.setattr(lm_score, "LEAST_SLICES", slices, raising=False)
        found = lm_score.score(docs, lm_score.train(docs, F.col("source") == "a")).collect()
        assert made.pop().count() == 60
        assert len(found) == 80
        for row in found:
            assert (row.target_loss, row.background_loss) == pytest.approx(want[row.doc_id])


def test_pair_numbers_are_one_to_one_and_spread():
    np = lm_score.np
    for size in (1, 2, 3, 100, 257):
        numbering = lm_score.Numbering(lm_score.Totals((1, 1), size), {}, size, 8)
        before, word = (c.ravel() for c in np.meshgrid(np.arange(size), np.arange(size)))
        pairs = numbering.pairs(before, word)
        assert len(np.unique(pairs)) == size * size and int(pairs.max()) >> numbering.bits == 0
    numbering = lm_score.Numbering(lm_score.Totals((1, 1), 10**6), {}, 10**6, 8)
    for before, word in ((7, np.arange(0, 10**6, 50)), (np.arange(20_000), 7)):  # a frequent word's bigrams
        of = np.bincount((numbering.pairs(np.broadcast_to(before, 20_000), np.broadcast_to(word, 20_000)) >> np.uint64(numbering.shift)).astype(int))
        assert len(of) == 256 and of.max() < 3 * of.mean()
    numbering = lm_score.Numbering(lm_score.Totals((1, 1), 1), {}, (1 << 32) - 1, 8)
    assert numbering.bits == 64 and len(set(numbering.pairs(np.array([1, 2, 1 << 31]), np.array([2, 1, 5])).tolist())) == 3


def test_slices_hold_the_same_bytes_however_many():
    np = lm_score.np
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 44, 200_000).astype(np.uint64))
    counts = np.ones(len(keys)), np.zeros(len(keys))
    sizes = []
    for bits in (1, 4, 8):
        rows = lm_score._cut(5, keys, counts, 44 - bits).to_pylist()
        assert [r["slice"] for r in rows] == list(range(1 << bits)) and {r["chunk"] for r in rows} == {5}
        back = [np.cumsum(lm_score._unpacked(r["keys"], np.uint64), dtype=np.uint64) + np.uint64(r["slice"] << (44 - bits)) for r in rows]
        assert np.array_equal(np.concatenate(back), keys)
        sizes.append(sum(len(r["keys"]) for r in rows))
    assert max(sizes) < 1.1 * min(sizes) < 1.1 * 5 * len(keys)
