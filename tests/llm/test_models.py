"""Quality and language models: held-out accuracy and defined edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strandline.llm import language_id, ordinal_quality, sampling

SCHEMA = "doc_id bigint, text string, lang string, score string, grade string"
LABELS = "doc_id bigint, quality int, toxic int, text string"
SYLLABLES = {
    "en": "the and of th er on re ing tion wh", "de": "der und ein sch keit ung ich ä ö en", "fr": "le les é è eau oi que ai ou tre",
    "es": "el los ción mente ñ ó ra que del as", "xx": "zz qq kk ww vv yy jj xx uu pp",
}


def text_in(lang, rng, words):
    own = SYLLABLES[lang].split()
    return " ".join("".join(rng.choices(own, k=rng.randint(1, 3))) for _ in range(words))


def test_languages(spark):
    rng = random.Random(1)
    rows = []
    for i in range(1_000):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, text_in(lang, rng, rng.randint(5, 60)), lang if i % 11 else None, None, None))
    rows += [(2_000, None, "en", None, None), (2_001, "", "en", None, None), (2_002, "12 345 !?", "de", None, None), (None, text_in("fr", rng, 30), "fr", None, None)]
    rows += [(2_003, text_in("es", rng, 200_000), None, None, None), rows[0]]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = language_id.identify(docs, language_id.train(docs))
    got = found.select("doc_id", "lang_pred", "score", language_id.held_out("doc_id").alias("held_out")).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    truth = {r[0]: r[2] for r in rows[:1_000]}
    held = [by_id[i].lang_pred == truth[i] for i in truth if truth[i] and zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean(held) > 0.97
    assert all(by_id[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in truth)
    assert [by_id[i].lang_pred for i in (2_000, 2_001, 2_002, None, 2_003)] == ["und", "und", "und", "fr", "es"]
    assert by_id[None].held_out is False and all(0 <= r.score <= 1 for r in got)


def test_held_out_labels_teach_nothing(spark):
    rng = random.Random(2)
    rows = [(i, text_in("en" if i % 2 else "de", rng, 30), "en" if i % 2 else "de", None, None) for i in range(300)]
    wrong = [(*r[:2], "fr" if zlib.crc32(str(r[0]).encode()) % 3 == 1 else r[2], *r[3:]) for r in rows]
    models = [language_id.train(spark.createDataFrame(x, SCHEMA)) for x in (rows, wrong)]
    assert models[0].families == models[1].families == [("de", "en")]
    assert np.allclose(models[0].pair_w["de", "en"], models[1].pair_w["de", "en"])


@pytest.mark.parametrize("rows", [[], [(1, "some text", None, None, None)], [(1, "123", "en", None, None)]])
def test_nothing_to_learn_from(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r)[1:] for r in language_id.identify(docs, language_id.train(docs)).collect()] == [("und", 0.0)] * len(rows)


def rated(rng, count):
    docs, labels = [], []
    for i in range(count):
        words = text_in(rng.choice(["en", "fr"]), rng, rng.randint(5, 80)).split()
        quality, toxic = rng.random() > 0.2, rng.random() < 0.2
        if not quality:
            words = [w + rng.choice(["%%%", "***"]) for w in words]
        if toxic:
            for _ in range(1 + len(words) // 30):
                words.insert(rng.randrange(len(words)), rng.choice(["moron", "scum"]))
        docs.append((i, " ".join(words), None, None, None))
        labels.append((i, int(quality), int(toxic), "x"))
    return docs, labels


def test_quality(spark):
    rng = random.Random(3)
    docs, labels = rated(rng, 1_600)
    known = labels[:1_000] + [(7_000, 1, 1, None), (None, 0, 0, None), (1, None, 1, None)]
    extra = [(5_000, None, None, None, None), (5_001, "", None, None, None), (None, "a b c", None, None, None), (5_002, "word " * 200_000, None, None, None)]
    frame = spark.createDataFrame(docs + extra + extra[:1], SCHEMA).repartition(4)
    model = ordinal_quality.train(frame, spark.createDataFrame(known, LABELS))
    assert (np.diff(model.thresholds) > 0).all()
    found = ordinal_quality.rate(frame, model).collect()
    assert len(found) == len(docs) + 5
    by_id = {r.doc_id: r for r in found}
    right = [by_id[d].keep == (q == 1 and t == 0) for d, q, t, _ in labels[1_000:]]
    assert np.mean(right) > 0.95
    worst = [by_id[d].expected_grade for d, q, t, _ in labels[1_000:] if t == 1]
    best = [by_id[d].expected_grade for d, q, t, _ in labels[1_000:] if q == 1 and t == 0]
    assert np.mean(worst) + 0.5 < np.mean(best)
    kept = ordinal_quality.keep_clean(frame, spark.createDataFrame(known, LABELS))
    assert kept.columns == frame.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(r.doc_id) for r in found if r.keep)


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(0)
    score, grades, free = rng.normal(size=9), rng.integers(0, 3, 9), np.array([-0.4, 0.8])

    def loss(score, free):
        ends = np.concatenate([[-50], free, [50]])
        at = lambda k: 1 / (1 + np.exp(-(ends[k] - score)))
        return -np.log(at(grades + 1) - at(grades)).sum()

    by_score, by_free = ordinal_quality._gradient(score, free, grades, 3)
    for i in range(9):
        step = np.eye(9)[i] * 1e-6
        assert (loss(score + step, free) - loss(score - step, free)) / 2e-6 == pytest.approx(by_score[i], abs=1e-4)
    for i in range(2):
        step = np.eye(2)[i] * 1e-6
        assert (loss(score, free + step) - loss(score, free - step)) / 2e-6 == pytest.approx(by_free[i], abs=1e-4)


@pytest.mark.parametrize("missing", [0, 1, 2])
def test_a_grade_that_no_row_has(missing):
    """The others are still told apart."""
    rng = random.Random(missing)
    docs, labels = rated(rng, 900)
    graded = [(ordinal_quality.features(d[1]), (1 - t) * (1 + q)) for d, (_, q, t, _) in zip(docs, labels)]
    graded = [(f, g) for f, g in graded if g != missing]
    half = len(graded) // 2
    model = ordinal_quality.fit([f for f, _ in graded[:half]], np.array([g for _, g in graded[:half]]), 3)
    tails = np.array([model.tails(float(v @ model.weights[p])) for p, v in (f for f, _ in graded[half:])])
    expected, truth = tails.sum(axis=1), np.array([g for _, g in graded[half:]])
    high, low = sorted({0, 1, 2} - {missing})[::-1]
    assert (expected[truth == high][:, None] > expected[truth == low][None]).mean() > 0.97
    assert (np.abs(expected - truth) < 0.5).mean() > 0.9


def test_quality_without_rows_or_labels(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    assert ordinal_quality.rate(docs, ordinal_quality.train(docs, labels)).collect() == []
    one = spark.createDataFrame([(1, "a", None, None, None)], SCHEMA)
    assert ordinal_quality.rate(one, ordinal_quality.train(one, labels)).count() == 1


def slow_language_features(text):
    """Hashed n-grams of a text in a dictionary, one after the other."""
    raw, size, counts = f" {' '.join(text.lower().split())} ".encode(), 1 << 32, Counter()
    for i in range(len(raw)):
        counts[raw[i] * 7 % 4096] += 1
        if i + 1 < len(raw):
            two = (raw[i] * 0x9E3779B1 + raw[i + 1] * 0x85EBCA6B) % size
            counts[(two >> 16) % 4096] += 1
        if i + 2 < len(raw):
            three = (two + raw[i + 2] * 0xC2B2AE35) % size
            counts[((three ^ (three >> 13)) * 0x27D4EB2F % size >> 15) % 4096] += 1
    length = math.sqrt(sum(counts.values()))
    return {k: math.sqrt(n) / length for k, n in counts.items()}


def slow_language(model, text):
    """Family by the largest margin, then language by votes; ties as documented."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    x = slow_language_features(text)
    margin = lambda w: sum(float(w[k]) * v for k, v in x.items()) + float(w[-1])
    sure = lambda m: 1 / (1 + math.exp(-2 * m))
    margins = [margin(w) for w in model.family_w]
    best = margins.index(max(margins))
    score = sure(margins[best] - max(m for i, m in enumerate(margins) if i != best)) if len(margins) > 1 else 1.0
    own = model.families[best]
    if len(own) == 1:
        return own[0], score
    votes, sums = Counter(), Counter()
    for (a, b), w in model.pair_w.items():
        if a in own:
            m = margin(w)
            votes[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
    found = max(own, key=lambda c: (votes[c], sums[c], c))
    return found, score * sure(2 * sums[found] / (len(own) - 1))


def test_languages_by_plain_loops(spark):
    rng = random.Random(8)
    texts = [text_in(rng.choice(list(SYLLABLES)), rng, rng.randint(1, 40)) for _ in range(300)]
    texts += [None, "", "1 2", "é", "A", "ß" * 3_000, "the\u00a0Der\tLE", texts[0]]
    docs = spark.createDataFrame([(i, t, rng.choice(list(SYLLABLES)) if i % 9 == 0 else None, None, None) for i, t in enumerate(texts)], SCHEMA)
    truth = spark.createDataFrame([(i, text_in(c, rng, 20), c, None, None) for i, c in enumerate(list(SYLLABLES) * 60)], SCHEMA)
    model = language_id.train(truth)
    for row in language_id.identify(docs, model).collect():
        lang, score = slow_language(model, texts[row.doc_id])
        assert row.lang_pred == lang and row.score == pytest.approx(score, abs=1e-5), texts[row.doc_id]


def test_machine_reaches_the_least_loss():
    """Against plain gradient descent with small steps."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 5))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=40) > 0.1, 1.0, -1.0)
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    slack = lambda w: np.maximum(0, 1 - y * (x @ w[:-1] + w[-1]))
    loss = lambda w: 0.005 * (w[:-1] ** 2).sum() + (weight * slack(w) ** 2).sum()
    slow = np.zeros(6)
    for _ in range(20_000):
        pull = weight * y * slack(slow)
        slow -= 0.05 * np.append(0.01 * slow[:-1] - 2 * pull @ x, -2 * pull.sum())
    assert loss(language_id.svm(x, y, 0.01, 2_000)) == pytest.approx(loss(slow), abs=1e-5)


def slow_rating(model, text):
    """Expected grade and tail probability of the best grade by loops over a dictionary."""
    raw = text.encode()
    tokens = re.findall(rb"[a-z\x80-\xff]+|[0-9]+|[^a-z0-9\x80-\xff\s]+", raw.lower())
    counts = Counter()
    for token in tokens:
        counts[zlib.crc32(token) % 65536] += 1
        for part, size in ((1, 4), (2, 5)):
            if len(token) > size:
                counts[65536 * part + zlib.crc32(token[:size]) % 65536] += 1
    words = [w.lower() for w in raw.split()]
    n, size = max(1, len(words)), max(1, len(raw))
    every_other = words[::2]
    rates = [
        sum(words[i] == words[i + 1] for i in range(len(words) - 1)) / n,
        sum(every_other[i] == every_other[i + 1] for i in range(len(every_other) - 1)) / n,
        max([words.count(w) for w in set(words)], default=0) / n,
        sum(w.isupper() for w in raw.split()) / n,
        sum(48 <= b <= 57 for b in raw) / size,
        sum(33 <= b <= 126 and not chr(b).isalnum() for b in raw) / size,
        1 - len(set(words)) / n,
        min(1.0, (raw.count(b"\n") + 1) / n),
    ]
    score = sum(math.log1p(c) * float(np.float32(model.weights[k])) for k, c in counts.items())
    score += sum(4 * r * float(np.float32(w)) for r, w in zip(rates, model.weights[-8:]))
    tails = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
    return sum(tails), tails[-1]


def test_ratings_by_plain_loops(spark):
    rng = random.Random(9)
    docs, labels = rated(rng, 300)
    texts = [d[1] for d in docs] + ["", "A A a 12 12 %% \n\n É é", "x", "!!!", "wordy\u00a0words"]
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    model = ordinal_quality.train(frame, spark.createDataFrame(labels, LABELS))
    for row in ordinal_quality.rate(frame, model).collect():
        expected, best = slow_rating(model, texts[row.doc_id])
        assert (row.expected_grade, row.p_clean) == pytest.approx((expected, best), abs=1e-5), texts[row.doc_id]
        assert row.keep == (row.p_clean >= ordinal_quality.KEEP)


def test_fit_reaches_the_least_loss():
    """Against a search that moves one coordinate at a time."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3))
    grades = np.digitize(x @ [1.0, -0.5, 0.0] + rng.normal(size=60), [-0.5, 0.7])

    def loss(point):
        score, ends = x @ point[:3], np.concatenate([[-50], point[3:], [50]])
        if point[4] - point[3] < ordinal_quality.GAP:
            return math.inf
        at = lambda k: 1 / (1 + np.exp(-(ends[k] - score)))
        return -np.log(at(grades + 1) - at(grades)).mean() + 0.01 * np.abs(point[:3]).sum()

    point, step = np.array([0, 0, 0, -0.5, 0.5]), 0.5
    while step > 1e-6:
        moves = [point + s * step * np.eye(5)[i] for i in range(5) for s in (1, -1)]
        best = min(moves, key=loss)
        point, step = (best, step) if loss(best) < loss(point) else (point, step / 2)
    model = ordinal_quality.fit([(np.arange(3), row) for row in x], grades, 3, 0.01, 3_000)
    found = np.r_[model.weights[:3], model.thresholds]
    assert loss(found) == pytest.approx(loss(point), abs=1e-5)
    assert found == pytest.approx(point, abs=0.02)


def test_one_id_on_many_rows_gives_a_sample_of_its_size(spark):
    docs = spark.createDataFrame([(1, f"text {i}", "en", None, None) for i in range(500)] + [(2, "other", "en", None, None)], SCHEMA)
    sample = sampling.sampled_ids(docs.select("doc_id", "lang"), "doc_id", ["lang"], 10)
    assert sample.count() <= 2
    assert sorted(sampling.texts_of(docs, spark.createDataFrame([(1, "en"), (3, "de")], "doc_id bigint, lang string"), "doc_id", "text").collect()) == [(1, "en", "text 0")]
    assert sampling.hashed_share(docs.select("doc_id"), "doc_id", 1_000).count() == 2
    assert sampling.hashed_share(docs.select("doc_id"), "doc_id", 100).count() <= 2


def test_columns_named_like_results_are_refused(spark):
    docs = spark.createDataFrame([(1, "a", "en", "7", "8")], SCHEMA)
    model = ordinal_quality.train(docs, spark.createDataFrame([], LABELS))
    with pytest.raises(ValueError, match="grade"):
        ordinal_quality.rate(docs, model, keep=("doc_id", "grade"))
    with pytest.raises(ValueError, match="score"):
        language_id.identify(docs, None, keep=("score",))
