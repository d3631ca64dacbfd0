"""Quality by ordinal regression: a cumulative-link model on graded ratings.

P(grade <= k) = sigmoid(threshold_k - score), with one score per text from shared
weights over hashed tokens and a few rates, and ordered thresholds.  The model
gives the expected grade and the tail probability of the best grade, by which
texts are selected.  Weights are fitted with an L1 penalty, so that words which
tell nothing weigh nothing and long texts are judged like short ones.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.batches import refuse_clash, small
from strandline.llm.sampling import hashed_share, texts_of

BUCKETS = 1 << 16
PREFIXES = (4, 5)  # bytes of a word's beginning that are hashed too, as words are inflected
RATES = 8
WIDTH = BUCKETS * (1 + len(PREFIXES)) + RATES
SAMPLE = 5_000  # labelled rows that are fitted on, about
PENALTY = 1e-3
ROUNDS = 250
KEEP = 0.6
FAR, GAP = 12.0, 1e-2  # bounds of the thresholds: a grade that no row has ends at the first, not at infinity

TOKEN = re.compile(rb"[a-z\x80-\xff]+|[0-9]+|[^a-z0-9\x80-\xff\s]+")


def grade(quality: Column, toxic: Column) -> Column:
    """0: toxic, 1: not toxic but poor, 2: good."""
    return (1 - toxic) * (1 + quality)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and values: log(1 + count) of hashed words and their beginnings,
    digit runs and symbol runs, and the rates of things that whole texts show."""
    raw = text.encode()
    tokens = TOKEN.findall(raw.lower())
    counts: Counter[int] = Counter()
    for token, n in Counter(tokens).items():
        counts[zlib.crc32(token) % BUCKETS] += n
    for part, size in enumerate(PREFIXES, 1):
        for token, n in Counter([t[:size] for t in tokens if len(t) > size]).items():
            counts[BUCKETS * part + zlib.crc32(token) % BUCKETS] += n
    places = np.fromiter(counts, np.int64, len(counts))
    values = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    words = raw.split()
    total, size = max(1, len(words)), max(1, len(raw))
    lower = [w.lower() for w in words]
    rates = np.array([
        sum(a == b for a, b in zip(lower, lower[1:])) / total,
        sum(a == b for a, b in zip(lower[::2], lower[2::2])) / total,
        max(Counter(lower).values(), default=0) / total,
        sum(w.isupper() for w in words) / total,
        len(re.findall(rb"[0-9]", raw)) / size,
        len(re.findall(rb"[!-/:-@\[-`{-~]", raw)) / size,
        1 - len(set(lower)) / total,
        min(1.0, len(raw.split(b"\n")) / total),
    ])
    return np.concatenate([places, WIDTH - RATES + np.arange(RATES)]), np.concatenate([values, 4 * rates])


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: float) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -500, 500)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int, penalty: float = PENALTY, rounds: int = ROUNDS) -> OrdinalModel:
    """Proximal gradient (FISTA) on the cumulative-link likelihood.  Without rows
    the thresholds are even and the weights zero."""
    thresholds = np.arange(n_grades - 1) - (n_grades - 2) / 2.0
    weights = np.zeros(WIDTH)
    if not rows:
        return OrdinalModel(weights, thresholds)
    seen = np.bincount(np.concatenate([p for p, _ in rows]), minlength=len(weights))
    known = np.flatnonzero(seen >= min(3, len(rows)))
    short = np.full(len(weights), -1)
    short[known] = np.arange(len(known))
    owner = np.repeat(np.arange(len(rows)), [len(p) for p, _ in rows])
    places = short[np.concatenate([p for p, _ in rows])]
    values = np.concatenate([v for _, v in rows])
    owner, places, values = owner[places >= 0], places[places >= 0], values[places >= 0]

    above = np.array([(grades > k).mean() for k in range(n_grades - 1)]).clip(1e-3, 1 - 1e-3)
    thresholds = _ordered(np.log((1 - above) / above))
    w, momentum_w, momentum_t, t = np.zeros(len(known)), np.zeros(len(known)), thresholds, 1.0
    n = len(rows)
    step = 4 / max(1.0, _norm(owner, places, values, n, len(known)))
    for _ in range(rounds):
        score = np.bincount(owner, values * momentum_w[places], n)
        slope, slope_t = _gradient(score, momentum_t, grades, n_grades)
        gradient = np.bincount(places, values * slope[owner], len(known)) / n
        new = momentum_w - step * gradient
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_t = _ordered(np.clip(momentum_t - slope_t / n, -FAR, FAR))
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        momentum_w, momentum_t = new + (t - 1) / t_new * (new - w), _ordered(new_t + (t - 1) / t_new * (new_t - thresholds))
        w, thresholds, t = new, new_t, t_new
    weights[known] = w
    return OrdinalModel(weights, thresholds)


def _norm(owner, places, values, n: int, width: int) -> float:
    """Largest eigenvalue of X'X / n, by power iteration."""
    x = np.ones(width) / math.sqrt(width)
    size = 1.0
    for _ in range(20):
        x = np.bincount(places, values * np.bincount(owner, values * x[places], n)[owner], width) / n
        size = np.linalg.norm(x) or 1.0
        x /= size
    return size


def _ordered(thresholds: np.ndarray) -> np.ndarray:
    """Each threshold at least ``GAP`` above the one before."""
    steps = GAP * np.arange(len(thresholds))
    return np.maximum.accumulate(thresholds - steps) + steps


def _gradient(score: np.ndarray, thresholds: np.ndarray, grades: np.ndarray, n_grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the negative log likelihood, by score and by threshold."""
    ends = np.concatenate([[-np.inf], thresholds, [np.inf]])
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    high, low = sigmoid(ends[grades + 1] - score), sigmoid(ends[grades] - score)
    high, low = np.where(grades + 1 == n_grades, 1.0, high), np.where(grades == 0, 0.0, low)
    mass = np.maximum(high - low, 1e-9)
    by_end = np.bincount(grades + 1, -high * (1 - high) / mass, n_grades + 1) + np.bincount(grades, low * (1 - low) / mass, n_grades + 1)
    return 1 - high - low, by_end[1:-1]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> OrdinalModel:
    """Fit on about ``sample`` labelled rows (quality and toxic, 0 or 1).  Labels
    that are null or have no document teach nothing."""
    rated = labels.filter("quality in (0, 1) and toxic in (0, 1)").select(F.col("doc_id").alias(id_col), "quality", "toxic")
    chosen = hashed_share(rated, id_col, sample)
    rows = texts_of(docs.filter(F.col(text_col).isNotNull()), chosen, id_col, text_col)
    rows = rows.select(grade(F.col("quality"), F.col("toxic")).cast("int").alias("grade"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [features(t) for t in batch.column(1).to_pylist()]
            places = pa.array([p.astype("<i4").tobytes() for p, _ in found], pa.binary())
            values = pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), places, values], ["grade", "places", "vals"])

    got = rows.mapInArrow(run, "grade int, places binary, vals binary").toPandas()  # bounded by the sample
    got = got.sort_values(["grade", "places", "vals"])  # the same order in every run
    pairs = [(np.frombuffer(p, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(np.float64)) for p, v in zip(got.places, got.vals)]
    return fit(pairs, got.grade.to_numpy(np.int64), 3)


SCHEMA = "expected_grade double, p_clean double, grade int, keep boolean"


def rate(docs: DataFrame, model: OrdinalModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = KEEP) -> DataFrame:
    """The ``keep`` columns of every row and expected_grade, p_clean (the tail
    probability of the best grade), grade (the most likely) and keep (p_clean of
    at least ``threshold``).  Null counts as the empty text.  One scan; the model
    is of fixed size.  ``keep`` columns may have any names but these."""
    refuse_clash(keep, SCHEMA)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("rated_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = OrdinalModel(*shared.value)
        for batch in small(batches):
            tails = []
            for text in batch.column(len(keep)).to_pylist():
                places, values = features(text)
                tails.append(own.tails(float(values @ own.weights[places])))
            tails = np.array(tails).reshape(batch.num_rows, -1)
            mass = -np.diff(np.concatenate([np.ones((len(tails), 1)), tails, np.zeros((len(tails), 1))], axis=1), axis=1)
            columns = [tails.sum(axis=1), tails[:, -1], mass.argmax(axis=1).astype(np.int32), tails[:, -1] >= threshold]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *map(pa.array, columns)], [*batch.schema.names[:-1], "expected_grade", "p_clean", "grade", "keep"]
            )

    return rows.mapInArrow(run, f"{fields}, {SCHEMA}")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = KEEP) -> DataFrame:
    """``docs`` without those that the model, trained on ``labels``, rejects: whole
    rows, in any columns, each judged by its own text (null as the empty text).  Equal
    texts are judged alike.  An empty table gives an empty one; without labels the model
    knows one score for all texts, whose tail is above ``threshold`` or not."""
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = OrdinalModel(*shared.value)
        for batch in small(batches):
            kept = []
            for text in batch.column(names.index("text")).to_pylist():
                places, values = features(text or "")
                kept.append(own.tails(float(values @ own.weights[places]))[-1] >= threshold)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
