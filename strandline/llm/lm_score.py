"""Cross-entropy difference of two matched bigram models.

The target model counts the documents that a condition names, the background model
all others.  Both share one vocabulary and one list of bigrams.  By default these
are all words and all bigrams.  What is gathered grows with the input: texts are held in
chunks of bounded size, which send their distinct words and bigrams to be counted and get
the counts in all chunks back.

Given shares instead, words of at least ``word_share`` and bigrams of at least
``pair_share`` of all events of either side are listed; other words are one unknown
word, other bigrams back off to their word.  A share of 1/n is reached by n items
at most, so both lists have a size bound and are broadcast.

A document's events are its words (A-Z lower-cased, cut at white space) and its
end, each after the one before, the first after a boundary::

    p1(w)    = (c(w) + 1) / (N + words of the vocabulary + 2)
    p(w | v) = (c(v, w) + MASS * p1(w)) / (c(v, listed) + MASS)

Loss is the mean of -log p over the events; a low difference is like the target.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.batches import give_back, small
from strandline.session import written

MASS = 4.0
HELD = 400_000  # distinct words or events that a task holds before it hands counts on

UNKNOWN, BOUNDARY = 0, 1
#: Event of a text's start and end; no word holds a space.
EDGE = xxhash.xxh64_intdigest(b" ") - (1 << 63)


def word_hash(word: bytes) -> int:
    value = xxhash.xxh64_intdigest(word)
    return value - (1 << 64) if value >> 63 else value


@dataclass
class Vocabulary:
    hashes: np.ndarray  # sorted; a word's id is its place plus 2

    def lookup(self) -> Words:
        return Words(self)


class Words:
    """Words to ids, each hashed once while it stays in the memo."""

    def __init__(self, vocabulary: Vocabulary):
        self.hashes, self.memo, self.older = vocabulary.hashes, {}, {}

    def ids(self, words: list[bytes]) -> np.ndarray:
        """The boundary, the words, and the boundary."""
        new = [w for w in set(words).difference(self.memo)]
        if new:
            if len(self.memo) >= HELD:
                self.memo, self.older, new = {}, self.memo, list(set(words))
            unseen = []
            for w in new:
                known = self.older.get(w)
                if known is None:
                    unseen.append(w)
                else:
                    self.memo[w] = known
            found = np.array([word_hash(w) for w in unseen], np.int64)
            at = np.searchsorted(self.hashes, found)
            at[at == len(self.hashes)] = 0
            ids = np.where(self.hashes[at] == found, at + 2, UNKNOWN) if len(self.hashes) else np.zeros(len(found), np.int64)
            self.memo.update(zip(unseen, ids.tolist()))
        out = np.ones(len(words) + 2, np.int64)
        out[1:-1] = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        return out


@dataclass
class PairModel:
    """Both models: of each side the count of every word, and of every listed
    bigram; a bigram is (id before) * (size of the vocabulary + 2) + id."""

    vocabulary: Vocabulary
    words: np.ndarray  # 2 rows: target, background
    pairs: np.ndarray  # sorted
    counts: np.ndarray  # 2 rows

    def __post_init__(self):
        size = self.words.shape[1]
        self.p1 = (self.words + 1.0) / (self.words.sum(axis=1, keepdims=True) + size)
        before = self.pairs // size
        self.listed = np.array([np.bincount(before, c, size) for c in self.counts])

    def losses(self, ids: np.ndarray) -> tuple[float, float]:
        size = self.words.shape[1]
        before, word = ids[:-1], ids[1:]
        key = before * size + word
        at = np.searchsorted(self.pairs, key)
        at[at == len(self.pairs)] = 0
        known = self.pairs[at] == key if len(self.pairs) else np.zeros(len(key), bool)
        out = []
        for side in (0, 1):
            count = np.where(known, self.counts[side][at], 0) if len(self.pairs) else 0.0
            p = (count + MASS * self.p1[side][word]) / (self.listed[side][before] + MASS)
            out.append(float(-np.log(p).mean()))
        return out[0], out[1]


COUNTS = "key bigint, target bigint, background bigint"


def _count_batch(keys, target, background) -> pa.RecordBatch:
    columns = [pa.array(np.asarray(c, np.int64)) for c in (keys, target, background)]
    return pa.RecordBatch.from_arrays(columns, ["key", "target", "background"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words by hash; the boundary comes as a key of its own side."""
    sides: tuple[Counter[bytes], Counter[bytes]] = (Counter(), Counter())

    def handed_on() -> pa.RecordBatch:
        words = list(sides[0].keys() | sides[1].keys())
        return _count_batch([word_hash(w) for w in words], [sides[0][w] for w in words], [sides[1][w] for w in words])

    for batch in small(batches):
        for text, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sides[0 if target else 1].update(text.lower().split())
            if len(sides[0]) + len(sides[1]) >= HELD:
                yield handed_on()
                sides[0].clear()
                sides[1].clear()
    yield handed_on()


def _texts(docs: DataFrame, target: Column, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(text.alias("lm_text"), F.coalesce(target, F.lit(False)).alias("lm_target")).filter("length(lm_text) > 0")


def _listed(counts: DataFrame, share: float, events: tuple[int, int]) -> list:
    """Keys that make up at least ``share`` of either side: 2 / share at most."""
    enough = [F.col(c) >= max(1.0, share * n) for c, n in zip(("target", "background"), events)]
    return counts.filter(enough[0] | enough[1]).toPandas().sort_values("key")


@dataclass
class PairTables:
    """Both models hold all words and bigrams of ``docs``.  The documents themselves are
    counted and scored by one shuffle; for others the counts of every word (key), the edge
    among them, and of every bigram (key, before, word) are stored once."""

    docs: DataFrame
    target: Column
    text_col: str

    @cached_property
    def pairs(self) -> DataFrame:
        return written(_pair_table(_texts(self.docs, self.target, self.text_col)), "pair-counts")

    @cached_property
    def words(self) -> DataFrame:
        """A word is counted by the bigrams it ends."""
        words = self.pairs.groupBy(F.col("word").alias("key")).agg(F.sum("target").alias("target"), F.sum("background").alias("background"))
        return written(words, "word-counts")


def _pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A hash of two word hashes, one to one in either."""
    x = before.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = ((x ^ (x >> np.uint64(32))) + word.view(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


class Hashes:
    """Word hashes of texts, each word hashed once while it stays in the memo."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def events(self, words: list[bytes]) -> np.ndarray:
        """The edge, the words, and the edge."""
        if len(self.memo) >= HELD:
            self.memo = {}
        self.memo.update((w, word_hash(w)) for w in set(words).difference(self.memo))
        out = np.full(len(words) + 2, EDGE, np.int64)
        out[1:-1] = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        return out


def _all_pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of bigrams with both their words."""
    hashes, held, sizes = Hashes(), [], 0

    def handed_on() -> pa.RecordBatch:
        before, word, target = (np.concatenate([np.zeros(0, np.int64), *(h[i] for h in held)]) for i in range(3))
        keys, first, place = np.unique(_pair_keys(before, word), return_index=True, return_inverse=True)
        of_target = np.bincount(place, target, len(keys)).astype(np.int64)
        columns = keys, before[first], word[first], of_target, np.bincount(place, minlength=len(keys)) - of_target
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "before", "word", "target", "background"])

    for batch in small(batches):
        for text, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = text.lower().split()
            if found:
                events = hashes.events(found)
                held.append((events[:-1], events[1:], np.full(len(found) + 1, int(target))))
                sizes += len(found)
                if sizes >= 4 * HELD:
                    yield handed_on()
                    held, sizes = [], 0
    yield handed_on()


def _pair_table(texts: DataFrame) -> DataFrame:
    counts = texts.mapInArrow(_all_pair_counts, "key bigint, before bigint, word bigint, target bigint, background bigint")
    sums = F.sum("target").alias("target"), F.sum("background").alias("background")
    return counts.groupBy("key").agg(F.first("before").alias("before"), F.first("word").alias("word"), *sums)


def _losses(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """key, end (1 for the end of a text) and the loss under either model of each
    bigram.  All bigrams are listed, so those after a word are as many as the word."""
    target, background, size = words.agg(F.sum("target"), F.sum("background"), F.count(F.when(F.col("key") != EDGE, 1))).first()
    events = {"target": target or 0, "background": background or 0}
    of_word, of_before = (words.select(F.col("key").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in events)) for k in ("word", "before"))
    both = pairs.join(of_word, "word", "left").join(of_before, "before", "left")

    def loss(side: str) -> Column:
        of = lambda c: F.coalesce(F.col(c), F.lit(0))
        p1 = (of(f"word_{side}") + 1.0) / float(events[side] + size + 2)
        return -F.log((F.col(side) + MASS * p1) / (of(f"before_{side}") + MASS))

    return both.select("key", (F.col("word") == EDGE).cast("int").alias("end"), loss("target").alias("target"), loss("background").alias("background"))


def _text_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct bigrams with the tags of the texts they are in and how often."""
    hashes, held, sizes = Hashes(), [], 0

    def handed_on() -> pa.RecordBatch:
        tags = np.array([t for t, _ in held], np.int64)
        keys = np.concatenate([np.zeros(0, np.int64), *(k for _, k in held)])
        texts = np.repeat(np.arange(len(held)), [len(k) for _, k in held])
        order = np.lexsort((texts, keys))
        keys, texts = keys[order], texts[order]
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (texts[1:] != texts[:-1])][: len(keys)])
        times = np.diff(np.r_[starts, len(keys)]).astype(np.int32)
        keys, texts = keys[starts], texts[starts]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        at = pa.array(np.r_[first, len(keys)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, pa.array(c)) for c in (tags[texts], times)]
        return pa.RecordBatch.from_arrays([pa.array(keys[first]), *lists], ["key", "tags", "times"])

    for batch in small(batches):
        for text, tag in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = text.lower().split()
            if found:
                events = hashes.events(found)
                held.append((tag, _pair_keys(events[:-1], events[1:])))
                sizes += len(found)
                if sizes >= 4 * HELD:
                    yield handed_on()
                    held, sizes = [], 0
    if held:
        yield handed_on()


def _score_by_tables(docs: DataFrame, model: PairTables, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """Losses are summed per distinct text, known by a hash; copies count alike above
    and below the line of the mean."""
    tag = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    pairs = model.pairs  # unseen bigrams have a loss as well
    unseen = _pair_table(_texts(docs, F.lit(False), text_col)).withColumns({"target": F.lit(0).cast("bigint"), "background": F.lit(0).cast("bigint")})
    pairs = pairs.unionByName(unseen.join(pairs, "key", "left_anti"))
    table = written(_losses(pairs, model.words), "pair-losses")
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("lm_text"), tag.alias("lm_tag"))
    met = texts.mapInArrow(_text_pairs, "key bigint, tags array<bigint>, times array<int>").join(table, "key")
    each = met.select(F.explode(F.arrays_zip("tags", "times")).alias("x"), "end", "target", "background")
    n = F.col("x.times")
    each = each.select(
        F.col("x.tags").alias("lm_tag"), n.alias("events"), (n * F.col("end")).alias("texts"),
        (n * F.col("target")).alias("t"), (n * F.col("background")).alias("b"),
    )
    return _per_text(docs.select(*keep, tag.alias("lm_tag")), each, ("lm_tag",), keep)


# --- counting and scoring the same documents --------------------------------

EVENTS_A_PART = 4_000_000  # occurrences of bigrams that are counted and scored together
BYTES_A_WORD = 6
RANGE_EVENTS = 500_000  # of those, how many are unfolded at a time


@dataclass
class Chunk:
    """Distinct texts of a task with their tags and how often either side has them,
    and their events: the hash before, the hash, the text's place."""

    tags: np.ndarray
    times: np.ndarray
    before: np.ndarray
    word: np.ndarray
    text: np.ndarray


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Texts gathered until they hold some 4 * HELD events.  A copy of a text that is
    held already adds to its times only."""
    hashes = Hashes()
    places: dict[tuple[int, int], int] = {}
    times: list[list[int]] = []
    held: list[np.ndarray] = []
    sizes = 0

    def chunk() -> Chunk:
        text = np.repeat(np.arange(len(held), dtype=np.int32), [len(e) - 1 for e in held])
        ends = np.cumsum([len(e) for e in held])
        events = np.concatenate(held)
        held.clear()  # the caller sorts: nothing but the chunk is held meanwhile
        hashes.memo = {}
        inner = np.ones(len(events), bool)
        inner[ends - 1] = False
        before = events[inner]
        inner[ends - 1] = True
        inner[np.r_[0, ends[:-1]]] = False
        return Chunk(np.array(list(places), np.int64), np.array(times, np.int64), before, events[inner], text)

    for batch in small(batches):
        for text, target, *tag in zip(*(c.to_pylist() for c in batch.columns)):
            place = places.get(tuple(tag))
            if place is None:
                found = text.lower().split()
                if not found:
                    continue
                place = places[tuple(tag)] = len(held)
                held.append(hashes.events(found))
                times.append([0, 0])
                sizes += len(found) + 1
            times[place][0 if target else 1] += 1
            if sizes >= 4 * HELD:
                yield chunk()
                places, times, held, sizes = {}, [], [], 0
    if held:
        yield chunk()


def _part_of(chunk: Chunk, side: int) -> np.ndarray:
    """Parts are a square: its rows by the hash of the word before, its columns by that
    of the word.  A word meets the parts of one row and one column."""

    def line(hashes: np.ndarray) -> np.ndarray:
        found = hashes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        found >>= np.uint64(32)
        found %= np.uint64(side)
        return found.astype(np.int32)

    part = line(chunk.before)
    part *= np.int32(side)
    part += line(chunk.word)
    return part


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the one before."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    changed = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        changed |= c[1:] != c[:-1]
    return np.flatnonzero(np.r_[True, changed])


def _word_rows(side: int):
    """(key, part, target, background): a word, a part in which it is in a bigram, and
    the events of the part that end in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = side * side
        for chunk in _chunks(batches):
            part = _part_of(chunk, side)
            chunk.before = None
            keys, place = np.unique(chunk.word, return_inverse=True)
            before = np.unique(np.roll(place, 1) * parts + part)  # a text ends with the edge, so the word before is the event before
            ends = place * parts + part
            chunk.word = place = part = None
            order = np.argsort(ends, kind="stable")
            ends, text = ends[order], chunk.text[order]
            first = _starts(ends)
            counts = [np.add.reduceat(chunk.times[:, i][text], first) for i in (0, 1)]
            ends = ends[first]
            other = np.setdiff1d(before, ends, assume_unique=True)
            code = np.r_[ends, other]
            columns = keys[code // parts], (code % parts).astype(np.int32), *(np.r_[c, np.zeros(len(other), np.int64)] for c in counts)
            before = ends = text = None
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "part", "target", "background"])
            other = code = columns = None
            give_back()

    return run


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers by planes of their bytes, which compress well."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.dtype.itemsize).T
    return zstandard.compress(planes.tobytes(), 1)


def _unpacked(packed: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


#: What a task hands on for one part: distinct texts (two tags and two times), distinct
#: words, bigrams as places of words (sorted, as steps), how many texts each is in, and
#: those texts' places with the times.
FIELDS = {"tags": np.int64, "times": np.int64, "words": np.int64, "before": np.uint32, "word": np.uint32, "texts": np.uint32, "text": np.uint32, "often": np.uint32}
PART_ROWS = "part int, kind int, key bigint, target bigint, background bigint, " + ", ".join(f"`{f}` binary" for f in FIELDS)


def _part_rows(side: int):
    """Rows of kind 1: what a chunk of texts has of one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("kind", pa.int32()), *((c, pa.int64()) for c in ("key", "target", "background")), *((f, pa.binary()) for f in FIELDS)])
        for chunk in _chunks(batches):
            part = _part_of(chunk, side)
            columns = [part, chunk.before, chunk.word, chunk.text]
            part = chunk.before = chunk.word = chunk.text = None
            order = np.lexsort(columns[::-1])
            for i in range(len(columns)):  # one at a time: the unsorted column goes
                columns[i] = columns[i][order]
            order = None
            first = _starts(*columns)
            often = np.diff(np.r_[first, len(columns[0])]).astype(np.uint32)
            for i in range(len(columns)):
                columns[i] = columns[i][first]
            part, before, word, text = columns
            columns = first = None
            edges = np.r_[_starts(part), len(part)]
            for i, j in zip(edges[:-1], edges[1:]):
                pair = _starts(before[i:j], word[i:j])
                starts, ends = before[i:j][pair], word[i:j][pair]
                words = np.union1d(starts[_starts(starts)], ends)
                steps = np.diff(np.searchsorted(words, starts), prepend=0)
                held = np.zeros(len(chunk.tags), bool)
                held[text[i:j]] = True
                own, at = np.flatnonzero(held), (np.cumsum(held, dtype=np.int32) - 1)[text[i:j]]
                columns = {
                    "tags": chunk.tags[own].ravel(), "times": chunk.times[own].ravel(), "words": words, "before": steps, "word": np.searchsorted(words, ends),
                    "texts": np.diff(np.r_[pair, j - i]), "text": at, "often": often[i:j],
                }
                starts = ends = None
                packed = {f: [_packed(columns[f].astype(k))] for f, k in FIELDS.items()}
                yield pa.RecordBatch.from_pydict({"part": [part[i]], "kind": [1], "key": [None], "target": [None], "background": [None], **packed}, schema)
            part = before = word = text = first = often = columns = None
            give_back()

    return run


@dataclass
class Totals:
    """Events of either side, and words of the vocabulary."""

    events: tuple[int, int]
    size: int


def _part_losses(keys: np.ndarray, counts: np.ndarray, rows: list[dict], totals: Totals) -> pa.RecordBatch:
    """Per text of a part: its events there, those that are its end, and their losses.
    A row's bigrams are in order, so they are taken by ranges of the word before, of some
    RANGE_EVENTS occurrences at a time."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[:, order].astype(np.float64)
    for row in rows:
        place = np.searchsorted(keys, row["words"]).astype(np.uint32)
        row["before"], row["word"] = place[np.cumsum(row["before"], dtype=np.uint32)], place[row["word"]]
        row["first"] = np.r_[0, np.cumsum(row["texts"], dtype=np.int64)]
        row["sums"] = np.zeros((4, len(row["tags"]) // 2))
    edges = _range_edges(rows, len(keys))
    for low, high in zip(edges[:-1], edges[1:]):
        _add_losses(low, high, keys, counts, rows, totals)
    tags = [row["tags"].reshape(-1, 2) for row in rows]
    sums = np.concatenate([row["sums"] for row in rows], axis=1)
    columns = np.concatenate([t[:, 0] for t in tags]), np.concatenate([t[:, 1] for t in tags]), *sums[:2].astype(np.int64), *sums[2:]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["lm_tag", "lm_tag2", "events", "texts", "t", "b"])


def _range_edges(rows: list[dict], size: int) -> np.ndarray:
    """Where to cut the places of the words before."""
    sizes = np.zeros(size, np.int64)
    for row in rows:
        sizes += np.bincount(row["before"], row["texts"], size).astype(np.int64)
    ranges = (np.cumsum(sizes) - sizes) // RANGE_EVENTS
    return np.r_[_starts(ranges), size]


def _add_losses(low: int, high: int, keys: np.ndarray, counts: np.ndarray, rows: list[dict], totals: Totals) -> None:
    """The bigrams after the words of places [low, high)."""
    codes, seen, spans = [], [], []
    for row in rows:
        i, j = np.searchsorted(row["before"], np.array([low, high], row["before"].dtype))
        a, b = row["first"][i], row["first"][j]
        spans.append((i, j, a, b))
        codes.append(row["before"][i:j].astype(np.int64) * len(keys) + row["word"][i:j])
        of_pair = np.repeat(np.arange(j - i), row["texts"][i:j])
        times, often = row["times"].reshape(-1, 2), row["often"][a:b]
        seen.append([np.bincount(of_pair, times[:, side][row["text"][a:b]] * often, j - i) for side in (0, 1)])
    pairs, at = np.unique(np.concatenate(codes), return_inverse=True)
    before, word = pairs // len(keys), pairs % len(keys)
    losses = []
    for side in (0, 1):
        p1 = (counts[side][word] + 1.0) / float(totals.events[side] + totals.size + 2)
        count = np.bincount(at, np.concatenate([s[side] for s in seen]), len(pairs))
        losses.append(-np.log((count + MASS * p1) / (counts[side][before] + MASS)))
    ends = (keys[word] == EDGE).astype(np.float64)
    start = 0
    for row, (i, j, a, b) in zip(rows, spans):
        own = np.repeat(at[start : start + j - i], row["texts"][i:j])
        start += j - i
        text, often = row["text"][a:b], row["often"][a:b].astype(np.float64)
        for total, v in zip(row["sums"], (np.ones(len(own)), ends[own], losses[0][own], losses[1][own])):
            total += np.bincount(text, often * v, len(total))


def _part_sums(totals: Totals):
    """Rows come by part, words (kind 0) before bigrams (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, words, rows = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if rows:
                keys, *counts = (np.concatenate(c) for c in zip(*words))
                yield _part_losses(keys, np.array(counts), rows, totals)

        for batch in batches:
            ids = batch.column("part").to_numpy()
            edges = np.r_[_starts(ids), len(ids)]
            for i, j in zip(edges[:-1], edges[1:]):
                if ids[i] != part:
                    yield from done()
                    part, words, rows = ids[i], [], []
                of_part = batch.slice(i, j - i)
                n = int((of_part.column("kind").to_numpy() == 0).sum())
                if n:
                    words.append([of_part.column(c).slice(0, n).to_numpy() for c in ("key", "target", "background")])
                fields = of_part.slice(n).select(list(FIELDS))
                rows += [{f: _unpacked(packed, FIELDS[f]) for f, packed in row.items()} for row in fields.to_pylist()]
        yield from done()
        words, rows = [], []
        give_back()

    return run


def _one_part(texts: DataFrame) -> DataFrame:
    """Sums of texts whose bigrams fit one part.  It gets the counts of all words, and what
    each task holds packed in a few rows."""
    found = texts.mapInArrow(_word_rows(1), "key bigint, part int, target bigint, background bigint")
    sums = [F.sum(c).alias(c) for c in ("target", "background")]
    words = found.repartition("key").groupBy("key", "part").agg(*sums).groupBy("key").agg(*sums, F.collect_list("part").alias("parts"))
    words = written(words, "word-counts")
    target, background, size = words.agg(F.sum("target"), F.sum("background"), F.count(F.when(F.col("key") != EDGE, 1))).first()
    totals = Totals((target or 0, background or 0), size)
    of_part = words.select(F.explode("parts").alias("part"), F.lit(0).alias("kind"), "key", "target", "background", *(F.lit(None).cast("binary").alias(f) for f in FIELDS))
    both = of_part.unionAll(texts.mapInArrow(_part_rows(1), PART_ROWS)).repartition("part").sortWithinPartitions("part", "kind")
    return both.mapInArrow(_part_sums(totals), SUMS)


SUMS = "lm_tag bigint, lm_tag2 bigint, events bigint, texts bigint, t double, b double"

# --- texts of more than one part --------------------------------------------

LEAST_SLICES = 256  # into which keys are cut; a slice is counted at a time

#: A stored chunk: its distinct texts (two tags, two times, events); of each event the place
#: of its word by frequency, and those places by hash; hashes (as steps) and counts of words.
CHUNK = {
    "tags": np.int64, "times": np.int64, "lengths": np.uint32, "events": np.uint32, "order": np.uint32,
    "words": np.uint64, "target": np.int64, "background": np.int64,
}
SLICE_ROWS = "slice int, chunk bigint, `keys` binary, target binary, background binary"
#: What a chunk gets back: the places of its keys among all of the slice, and their counts in
#: all chunks.  A slice of words adds a row without a chunk, with its words and events.
TOTAL_ROWS = "slice int, chunk bigint, kind int, places binary, target binary, background binary, size bigint, n_target bigint, n_background bigint"


def _rows_of(columns: dict, schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.strip().replace("`", "").split() for f in schema.split(",")]
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), kinds[k]) for c, k in fields], [c for c, _ in fields])


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in _chunks(batches):
        chunk.before = None
        words, place, often = np.unique(chunk.word.view(np.uint64), return_inverse=True, return_counts=True)
        chunk.word = None
        counts = [np.bincount(place, chunk.times[:, side][chunk.text]) for side in (0, 1)]
        order = np.argsort(-often, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        lengths = np.bincount(chunk.text, minlength=len(chunk.tags))
        columns = chunk.tags.ravel(), chunk.times.ravel(), lengths, rank[place], order, np.diff(words, prepend=np.uint64(0)), *counts
        place = None
        yield pa.RecordBatch.from_pydict({f: [_packed(c.astype(k))] for (f, k), c in zip(CHUNK.items(), columns)})
        chunk = columns = counts = None
        give_back()


def _cut(chunk: int, keys: np.ndarray, counts: tuple[np.ndarray, np.ndarray], shift: int) -> pa.RecordBatch:
    """Sorted keys of a chunk by slices, which are ranges: so steps stay small, however
    many slices there are."""
    of = keys >> np.uint64(shift)
    edges = np.r_[_starts(of), len(keys)]
    rows: dict[str, list] = {"slice": [], "chunk": [], "keys": [], "target": [], "background": []}
    for i, j in zip(edges[:-1], edges[1:]):
        own = np.diff(keys[i:j], prepend=of[i] << np.uint64(shift)), *(c[i:j].astype(np.int64) for c in counts)
        for name, value in zip(rows, (int(of[i]), chunk, *map(_packed, own))):
            rows[name].append(value)
    return _rows_of(rows, SLICE_ROWS)


def _word_slices(shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                steps, *counts = (_unpacked(row[f], CHUNK[f]) for f in ("words", "target", "background"))
                yield _cut(row["chunk"], np.cumsum(steps, dtype=np.uint64), counts, shift)

    return run


def _slice_totals(kind: int):
    """Rows come by slice.  Kind 0, of words, tells places and sizes as well."""

    def totals(number: int, rows: list[dict]) -> pa.RecordBatch:
        keys = [np.cumsum(_unpacked(r["keys"], np.uint64), dtype=np.uint64) for r in rows]
        ends = np.cumsum([0, *map(len, keys)])
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        keys = None
        sums = []
        for side in ("target", "background"):
            sums.append(np.bincount(place, np.concatenate([_unpacked(r[side], np.int64) for r in rows]), len(distinct)).astype(np.int64))
        out = {"slice": [number] * len(rows), "chunk": [r["chunk"] for r in rows], "kind": [kind] * len(rows), "places": [None] * len(rows)}
        for side, total in zip(("target", "background"), sums):
            out[side] = [_packed(total[place[i:j]]) for i, j in zip(ends[:-1], ends[1:])]
        if kind == 0:
            out["places"] = [_packed(np.diff(place[i:j], prepend=0).astype(np.uint32)) for i, j in zip(ends[:-1], ends[1:])]
            for column, value in zip(out.values(), (number, None, kind, None, None, None)):
                column.append(value)
            for name, value in zip(("size", "n_target", "n_background"), (len(distinct), *(int(s.sum()) for s in sums))):
                out[name] = [None] * len(rows) + [value]
        return _rows_of(out, TOTAL_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["slice"] != number:
                    if rows:
                        yield totals(number, rows)
                    number, rows = row["slice"], []
                rows.append(row)
        if rows:
            yield totals(number, rows)
        rows = []
        give_back()

    return run


@dataclass
class Numbering:
    """Words are numbered over all slices: those of a slice from its start on."""

    totals: Totals
    starts: dict[int, int]
    words: int
    slice_bits: int

    @property
    def bits(self) -> int:
        return min(64, max(self.slice_bits, (self.words * self.words - 1).bit_length()))

    @property
    def shift(self) -> int:
        return self.bits - self.slice_bits

    def pairs(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """A number of ``bits`` bits for two words, one to one (up to 2 ** 32 words) and
        mixed, so that the bigrams of a frequent word are in all slices."""
        bits, mask = self.bits, np.uint64((1 << self.bits) - 1)
        x = before.astype(np.uint64) * np.uint64(self.words) + word.astype(np.uint64)
        x = x * np.uint64(0x9E3779B97F4A7C15) & mask
        x ^= x >> np.uint64(max(1, bits // 2))
        return x * np.uint64(0xC2B2AE3D27D4EB4F) & mask


@dataclass
class Events:
    """Of a chunk: its texts' tags and times; of its events the text, the place of the word
    among those of the chunk, and that of the bigram; the distinct bigrams, sorted; and
    either side's counts of its words in all chunks."""

    tags: np.ndarray
    times: np.ndarray
    text: np.ndarray
    word: np.ndarray
    pair: np.ndarray
    pairs: np.ndarray
    counts: list[np.ndarray]


def _events(chunk: pa.Table, found: list[dict], numbering: Numbering) -> Events:
    own = {f: _unpacked(v, CHUNK[f]) for f, v in chunk.drop_columns("chunk").to_pylist()[0].items()}
    rows = [r for r in found if r["kind"] == 0]
    ids = np.concatenate([np.cumsum(_unpacked(r["places"], np.uint32), dtype=np.int64) + numbering.starts[r["slice"]] for r in rows])
    counts = [np.concatenate([_unpacked(r[side], np.int64) for r in rows]) for side in ("target", "background")]
    word = own["order"][own["events"]]
    ids = ids[word]
    pairs, pair = np.unique(numbering.pairs(np.roll(ids, 1), ids), return_inverse=True)  # a text ends with the edge, which is before the next
    text = np.repeat(np.arange(len(own["lengths"]), dtype=np.int32), own["lengths"])
    return Events(own["tags"].reshape(-1, 2), own["times"].reshape(-1, 2), text, word, pair, pairs, counts)


def _by_slice(found: pa.Table) -> list[dict]:
    return sorted(found.to_pylist(), key=lambda r: r["slice"])


def _pair_slices(numbering: Numbering):
    def run(chunk: pa.Table, found: pa.Table) -> pa.Table:
        e = _events(chunk, _by_slice(found), numbering)
        counts = [np.bincount(e.pair, e.times[:, side][e.text], len(e.pairs)) for side in (0, 1)]
        rows = _cut(chunk["chunk"][0].as_py(), e.pairs, counts, numbering.shift)
        e = counts = None
        give_back()
        return pa.Table.from_batches([rows])

    return run


def _chunk_sums(numbering: Numbering):
    """Per text of a chunk: its events, its ends (one), and its losses."""

    def run(chunk: pa.Table, found: pa.Table) -> pa.Table:
        found = _by_slice(found)
        e = _events(chunk, found, numbering)
        n, totals = len(e.tags), numbering.totals
        sums = []
        for side, column in enumerate(("target", "background")):
            count = np.concatenate([_unpacked(r[column], np.int64) for r in found if r["kind"] == 1])
            of_word = e.counts[side][e.word].astype(np.float64)
            p1 = (of_word + 1.0) / float(totals.events[side] + totals.size + 2)
            loss = -np.log((count[e.pair] + MASS * p1) / (np.roll(of_word, 1) + MASS))
            sums.append(np.bincount(e.text, loss, n))
        columns = e.tags[:, 0], e.tags[:, 1], np.bincount(e.text, minlength=n), np.ones(n, np.int64), *sums
        rows = _rows_of(dict(zip(("lm_tag", "lm_tag2", "events", "texts", "t", "b"), columns)), SUMS)
        e = found = columns = sums = None
        give_back()
        return pa.Table.from_batches([rows])

    return run


def _by_chunks(texts: DataFrame, events: int) -> DataFrame:
    """Sums of texts, in whose chunks all is stored once.  A chunk sends its distinct words,
    then its distinct bigrams, by slices of their numbers; a slice counts those of all chunks
    and sends each chunk the counts of its own.  So a text is scored in one place, and what
    moves is a few bytes for each distinct bigram of a chunk, whatever the input."""
    bits = max(LEAST_SLICES - 1, events // EVENTS_A_PART).bit_length()
    fields = ", ".join(f"`{f}` binary" for f in CHUNK)
    chunks = written(texts.mapInArrow(_chunk_rows, fields).withColumn("chunk", F.monotonically_increasing_id()), "chunks")

    def counted(rows: DataFrame, kind: int) -> DataFrame:
        return rows.repartition("slice").sortWithinPartitions("slice").mapInArrow(_slice_totals(kind), TOTAL_ROWS)

    words = chunks.select("chunk", "words", "target", "background").mapInArrow(_word_slices(64 - bits), SLICE_ROWS)
    words = written(counted(words, 0), "word-counts")
    sizes = sorted(words.filter("chunk is null").select("slice", "size", "n_target", "n_background").collect())
    starts, size = {}, 0
    for row in sizes:
        starts[row[0]] = size
        size += row[1]
    totals = Totals((sum(r[2] for r in sizes), sum(r[3] for r in sizes)), max(0, size - 1))  # the edge is none of the vocabulary
    numbering = Numbering(totals, starts, max(1, size), bits)
    words = words.filter("chunk is not null").drop("size", "n_target", "n_background")
    own = chunks.select("chunk", "tags", "times", "lengths", "events", "order").groupBy("chunk")
    pairs = own.cogroup(words.groupBy("chunk")).applyInArrow(_pair_slices(numbering), SLICE_ROWS)
    both = words.unionByName(counted(pairs, 1).select(*words.columns))
    return own.cogroup(both.groupBy("chunk")).applyInArrow(_chunk_sums(numbering), SUMS)


def _score_own(model: PairTables, keep: tuple[str, ...]) -> DataFrame:
    """Events are counted over all documents, and every distinct text gets the sum of its
    losses: in one part if they are few, else by chunks."""
    docs, text = model.docs, F.coalesce(F.col(model.text_col), F.lit(""))
    tags = {"lm_tag": F.xxhash64(text), "lm_tag2": F.xxhash64(text, F.lit(1))}
    texts = docs.select(text.cast("binary").alias("lm_text"), F.coalesce(model.target, F.lit(False)).alias("lm_target"), *(c.alias(n) for n, c in tags.items()))
    texts = texts.filter("length(lm_text) > 0")
    length = texts.agg(F.sum(F.length("lm_text"))).first()[0] or 0
    events = length // BYTES_A_WORD
    each = _one_part(texts) if events < EVENTS_A_PART else _by_chunks(texts, events)
    return _per_text(docs.select(*keep, *(c.alias(n) for n, c in tags.items())), each, tuple(tags), keep)


def _per_text(rows: DataFrame, sums: DataFrame, tags: tuple[str, ...], keep: tuple[str, ...]) -> DataFrame:
    """Scores of rows with tags from sums over the bigrams of each tag.  Copies count
    alike above and below the line of the mean."""
    whole = sums.groupBy(*tags).agg(*(F.sum(c).alias(c) for c in ("events", "texts", "t", "b")))
    whole = whole.select(
        *tags, F.expr("events div texts - 1").alias("n_words"), (F.col("t") / F.col("events")).alias("target_loss"),
        (F.col("b") / F.col("events")).alias("background_loss"),
    )
    difference = (F.col("target_loss") - F.col("background_loss")).alias("difference")
    n_words = F.coalesce("n_words", F.lit(0).cast("bigint")).alias("n_words")
    return rows.join(whole, list(tags), "left").select(*keep, n_words, "target_loss", "background_loss", difference)


def train(
    docs: DataFrame, target: Column, text_col: str = "text", word_share: float = 0.0, pair_share: float = 0.0
) -> PairModel | PairTables:
    """Count all documents: words first, then bigrams over the shared vocabulary.
    Documents without a word teach nothing; a null condition is background."""
    texts = _texts(docs, target, text_col)
    if not word_share and not pair_share:
        return PairTables(docs, target, text_col)
    words = texts.mapInArrow(_word_counts, COUNTS).groupBy("key").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))
    words = written(words, "word-counts")
    sums = words.agg(F.sum("target"), F.sum("background")).first()
    totals = int(sums[0] or 0), int(sums[1] or 0)
    listed = _listed(words, word_share, totals)
    vocabulary = Vocabulary(listed.key.to_numpy(np.int64))
    size = len(vocabulary.hashes) + 2
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, held, sizes = shared.value.lookup(), ([], []), 0

        def handed_on() -> pa.RecordBatch:
            keys, counts = zip(*(np.unique(np.concatenate([np.zeros(0, np.int64), *h]), return_counts=True) for h in held))
            both = np.union1d(*keys)
            out = np.zeros((2, len(both)), np.int64)
            for side in (0, 1):
                out[side, np.searchsorted(both, keys[side])] = counts[side]
            return _count_batch(both, *out)

        for batch in small(batches):
            for text, is_target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = text.lower().split()
                if found:
                    ids = lookup.ids(found)
                    held[0 if is_target else 1].append(ids[:-1] * size + ids[1:])
                    sizes += len(ids)
                    if sizes >= 10 * HELD:
                        yield handed_on()
                        held, sizes = ([], []), 0
        yield handed_on()

    pairs = texts.mapInArrow(pair_counts, COUNTS).groupBy("key").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))
    pairs = written(pairs, "pair-counts")
    ends = pairs.filter(F.col("key") % size == BOUNDARY).agg(F.sum("target"), F.sum("background")).first()
    ends = int(ends[0] or 0), int(ends[1] or 0)  # documents of each side
    kept = _listed(pairs, pair_share, (totals[0] + ends[0], totals[1] + ends[1]))
    counts = np.zeros((2, size), np.int64)
    for side, column in enumerate(("target", "background")):
        counts[side, 2:] = listed[column]
        counts[side, UNKNOWN] = totals[side] - counts[side, 2:].sum()
        counts[side, BOUNDARY] = ends[side]
    both = np.array([kept.target.to_numpy(np.int64), kept.background.to_numpy(np.int64)]).reshape(2, -1)
    return PairModel(vocabulary, counts, kept.key.to_numpy(np.int64), both)


SCHEMA = "n_words bigint, target_loss double, background_loss double, difference double"


def score(docs: DataFrame, model: PairModel | PairTables, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of every row, n_words, the loss per event under either
    model, and difference (target less background).  Null, empty and wordless
    texts have 0 words and null losses.  A model with shares takes one scan.  A ``keep``
    column named like a result, or ``lm_tag`` or ``lm_tag2``, is an error."""
    taken = {"n_words", "target_loss", "background_loss", "difference", "lm_tag", "lm_tag2"}.intersection(keep)
    if taken:
        raise ValueError(f"keep columns named like results: {', '.join(sorted(taken))}")
    if isinstance(model, PairTables):
        same = docs is model.docs and text_col == model.text_col
        return _score_own(model, keep) if same else _score_by_tables(docs, model, text_col, keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("lm_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        lookup = own.vocabulary.lookup()
        for batch in small(batches):
            out = []
            for text in batch.column(len(keep)).to_pylist():
                words = text.lower().split()
                loss = own.losses(lookup.ids(words)) if words else (None, None)
                out.append((len(words), *loss, loss[0] - loss[1] if words else None))
            columns = list(zip(*out)) or [()] * 4
            kinds = (pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(list(c), k) for c, k in zip(columns, kinds))],
                [*batch.schema.names[:-1], "n_words", "target_loss", "background_loss", "difference"],
            )

    return rows.mapInArrow(run, f"{fields}, {SCHEMA}")
