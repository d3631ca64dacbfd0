"""Language identification in two steps: family, then language.

Texts are unit vectors of hashed byte n-grams.  Linear support vector machines,
one against the rest, choose the family; within it machines for each pair of
languages vote.  Machines are fitted on a bounded sample with squared hinge loss.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.batches import refuse_clash, small
from strandline.llm.sampling import sampled_ids, texts_of

BUCKETS = 1 << 12
SAMPLE_PER_LANGUAGE = 400
SAMPLE = 10_000
PENALTY = 1e-4
ROUNDS = 80
PIECE = 1 << 20  # bytes of a long text that are hashed at a time

#: Families of closely related languages; a language not named is its own.
FAMILIES = {
    "germanic": ("de", "en", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "fy", "lb", "yi"),
    "romance": ("fr", "es", "pt", "it", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "bs"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "mt", "am"),
    "indic": ("hi", "bn", "ur", "pa", "mr", "gu", "ne", "si"),
    "celtic": ("ga", "cy", "gd", "br"),
}


def held_out(id_col: str) -> Column:
    """Documents that are never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def features(text: str) -> np.ndarray:
    """Unit vector of the square roots of hashed n-gram counts, 1 to 3 bytes."""
    raw = np.frombuffer(f" {' '.join(text.lower().split())} ".encode(), np.uint8)
    counts = np.zeros(BUCKETS)
    for at in range(0, len(raw), PIECE):
        a = raw[at : at + PIECE + 2].astype(np.uint32)
        end = min(PIECE, len(raw) - at)
        counts += np.bincount(a[:end] * 7 % BUCKETS, minlength=BUCKETS)
        two = a[:-1] * np.uint32(0x9E3779B1) + a[1:] * np.uint32(0x85EBCA6B)
        counts += np.bincount((two[:end] >> 16) % BUCKETS, minlength=BUCKETS)
        three = two[:-1] + a[2:] * np.uint32(0xC2B2AE35)
        counts += np.bincount(((three ^ (three >> 13)) * np.uint32(0x27D4EB2F) >> 15)[:end] % BUCKETS, minlength=BUCKETS)
    root = np.sqrt(counts)
    return (root / np.linalg.norm(root)).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> np.ndarray:
    """Weights and bias of a linear machine; y is 1 or -1, classes weigh alike.
    Accelerated gradient descent on the squared hinge loss."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = ahead = np.zeros(x.shape[1] + 1)
    t = 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead[:-1] + ahead[-1]))
        pull = weight * y * slack
        gradient = np.append(penalty * ahead[:-1] - 2 * (pull @ x), -2 * pull.sum())
        new = ahead - 0.2 * gradient  # rows have length 1, so the curvature is at most 4
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, ahead, t = new, new + (t - 1) / t_new * (new - w), t_new
    return w


@dataclass
class LanguageModel:
    families: list[tuple[str, ...]]  # languages of each family, in order
    family_w: np.ndarray  # a row for each family, bias last
    pair_w: dict[tuple[str, str], np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """Language, and how sure both steps are together (0 to 1)."""
        margins = self.family_w[:, :-1] @ x + self.family_w[:, -1]
        best = int(margins.argmax())
        score = 1.0
        if len(margins) > 1:
            score = _sure(margins[best] - np.delete(margins, best).max())
        languages = self.families[best]
        if len(languages) == 1:
            return languages[0], score
        votes, sums = dict.fromkeys(languages, 0), dict.fromkeys(languages, 0.0)
        for (a, b), w in self.pair_w.items():
            if a in votes:
                margin = float(w[:-1] @ x + w[-1])
                votes[a if margin >= 0 else b] += 1
                sums[a] += margin
                sums[b] -= margin
        found = max(languages, key=lambda c: (votes[c], sums[c], c))
        return found, score * _sure(2 * sums[found] / (len(languages) - 1))


def _sure(margin: float) -> float:
    return float(1 / (1 + np.exp(-2 * margin)))


def fit(x: np.ndarray, languages: list[str], families: Mapping[str, tuple[str, ...]] = FAMILIES) -> LanguageModel:
    kin = {code: name for name, codes in families.items() for code in codes}
    grouped: dict[str, list[str]] = {}
    for code in sorted(set(languages)):
        grouped.setdefault(kin.get(code, f"only {code}"), []).append(code)
    own = np.array([kin.get(c, f"only {c}") for c in languages])
    names, codes = sorted(grouped), np.array(languages)
    family_w = np.array([svm(x, np.where(own == n, 1.0, -1.0)) if len(names) > 1 else np.zeros(x.shape[1] + 1) for n in names])
    pair_w = {}
    for name in names:
        for a, b in combinations(grouped[name], 2):
            here = (codes == a) | (codes == b)
            pair_w[a, b] = svm(x[here], np.where(codes[here] == a, 1.0, -1.0))
    return LanguageModel([tuple(grouped[n]) for n in names], family_w, pair_w)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """Fit on documents with a language that are not held out: of each language
    ``SAMPLE_PER_LANGUAGE``, fewer where that would exceed ``SAMPLE`` in all.  None
    where there is nothing to learn from."""
    known = docs.select(id_col, F.col(lang_col).alias("label_lang")).filter(
        F.col("label_lang").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)
    )
    n_langs = known.select("label_lang").distinct().count()
    if not n_langs:
        return None
    sample = sampled_ids(known, id_col, ["label_lang"], max(1, min(SAMPLE_PER_LANGUAGE, SAMPLE // n_langs)))
    rows = texts_of(docs.filter(F.col(text_col).rlike("\\p{L}")), sample, id_col, text_col)
    rows = rows.select("label_lang", F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [features(t).astype("<f2").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["lang", "x"])

    got = rows.mapInArrow(run, "lang string, x binary").toPandas().sort_values(["lang", "x"])  # bounded by the sample
    if not len(got):
        return None
    x = np.frombuffer(b"".join(got.x), "<f2").reshape(len(got), BUCKETS).astype(np.float32)
    return fit(x, list(got.lang))


SCHEMA = "lang_pred string, score double"


def identify(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of every row, lang_pred and score.  Texts that are null
    or have no letter, and all texts without a model, are ``und`` with score 0.
    One scan; the model grows with the number of languages only.  ``keep`` may not
    hold one of the names added; repeated rows and ids each have their own row."""
    refuse_clash(keep, SCHEMA)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    rows = docs.select(*keep, F.col(text_col).alias("judged_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in small(batches):
            found = []
            for text in batch.column(len(keep)).to_pylist():
                letters = own is not None and text is not None and any(map(str.isalpha, text))
                found.append(own.predict(features(text)) if letters else ("und", 0.0))
            langs, scores = zip(*found) if found else ((), ())
            columns = [*batch.columns[:-1], pa.array(list(langs), pa.string()), pa.array(list(scores), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "lang_pred", "score"])

    return rows.mapInArrow(run, f"{fields}, {SCHEMA}")
