"""Spelling variants: words that differ by one inserted, deleted or replaced character.

A sorted list of words is compared with each of its words by the edit matrix.  With a
bound of one edit only three cells of a matrix row count, and the rows of a word are
those of its neighbour up to their longest common prefix (LCP).  So a row is worked
out once for each distinct prefix, that is for each range of the list that shares it,
and where all three cells exceed one edit the range is skipped.  All words of a list
are compared in one go: each step takes every open (word, range) pair a character on.

The vocabulary is cut into such lists so that no pair is lost.  Let m be the length of
a pair's shorter word and j the length of the pair's common prefix (0 to m).  For any
window [a, b) that holds j, both words share their first a characters and their last
m - b.  Two windows cover 0 to m, so a word enters four lists: two for pairs in which
it is the shorter or as long, two for those in which it is the longer.  A list with
too many words is cut anew by the halves of its window; at a window of one place a
list has no more words than two free characters allow.  A pair counts only in the
window that holds j, so once.  Lists hand on one row per word, never pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.batches import small
from strandline.operators.skew import lookup_join
from strandline.session import written

RUN = re.compile("[a-zA-ZÀ-ÿ]+")
SHORTEST = 5
FEWEST = 3
DELETED = 97
HELD = 400_000  # distinct words a task counts before it hands counts on
LIST = 20_000  # words of a list that is not cut anew
TOGETHER = 20_000  # words of whole lists that are compared in one go
BLOCK = 2_048  # words of a list compared at a time
FAR = np.int8(2)


def counted(doc_id: int | None, text: bytes, counts: Counter[str], shortest: int) -> None:
    """Add the words of a text.  Runs of one spelling in one document are alike."""
    seed = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    for word, times in Counter(RUN.findall(text.lower().decode("utf-8", "replace"))).items():
        place = zlib.crc32(word.encode(), seed)
        if not place % DELETED:
            at = place % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= shortest:
            counts[word] += times


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """(word, n) of all words long and frequent enough, over all documents.  Tasks
    hand on counts of words, so a word that is everywhere is a row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def handed_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in small(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counted(doc_id, text, counts, shortest)
                if len(counts) >= HELD:
                    yield handed_on()
                    counts.clear()
        if counts:
            yield handed_on()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).filter("text is not null")
    sums = rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return sums.filter(F.col("n") >= fewest)


def near_pairs(codes: np.ndarray, lens: np.ndarray, lists: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (first below second) of sorted lists of distinct words, one list
    after the other, that are of one list and one edit apart.  ``codes``: a row of
    code points a word, filled up with zeros; ``lists``: the number of its list."""
    size, width = codes.shape
    if size < 2:
        return
    lcp = np.where(lists[1:] == lists[:-1], np.argmax(codes[1:] != codes[:-1], axis=1), -1)
    # Ranges of each depth: where they start, and where the shared prefix ends.
    starts, ends = [], []
    for depth in range(width + 1):
        cuts = np.concatenate([[0], np.flatnonzero(lcp < depth) + 1, [size]])
        ranges = cuts[:-1], cuts[1:]
        within = codes[ranges[0], depth - 1] != 0 if depth else np.ones(len(cuts) - 1, bool)
        starts.append(ranges[0][within])
        ends.append(ranges[1][within])
    padded = np.concatenate([codes, np.zeros((size, 2), codes.dtype)], axis=1)
    for block in range(0, size, BLOCK):
        word = np.arange(block, min(block + BLOCK, size))
        node = lists[word] - lists[0]
        row = np.empty((3, len(word)), np.int8)  # distances to the word's first depth-1, depth, depth+1 characters
        row[0], row[1], row[2] = FAR, 0, 1
        depth = 0
        while len(word) and depth < width:
            first = np.searchsorted(starts[depth + 1], starts[depth][node])
            last = np.searchsorted(starts[depth + 1], ends[depth][node])
            times = last - first
            at = np.repeat(np.arange(len(word)), times)
            into = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times) + first[at]
            ahead = ends[depth + 1][into] - 1 > word[at]  # a range wholly above the word was met from its side
            at, into = at[ahead], into[ahead]
            word, node = word[at], into
            char = codes[starts[depth + 1][node], depth]
            before, here, after = row[:, at]
            old = padded[word, depth - 1] if depth else np.zeros(len(word), codes.dtype)
            depth += 1
            left = lens[word]
            new0 = np.minimum(before + (char != old), here + 1)
            new1 = np.minimum(np.minimum(here + (char != padded[word, depth - 1]), after + 1), new0 + 1)
            new1[depth > left] = FAR
            new2 = np.minimum(after + (char != padded[word, depth]), new1 + 1)
            new2[depth + 1 > left] = FAR
            new0[depth - 1 > left] = FAR
            row = np.minimum(np.stack([new0, new1, new2]), FAR).astype(np.int8)
            open_ = row.min(axis=0) < FAR  # otherwise the whole range is skipped
            word, node, row = word[open_], node[open_], row[:, open_]
            other = starts[depth][node]
            more = lens[word] - depth
            at = np.flatnonzero((lens[other] == depth) & (other > word) & (np.abs(more) <= 1))
            at = at[row[more[at] + 1, at] == 1]
            if len(at):
                yield word[at], other[at]


def compare(words: list[str], n: np.ndarray, lists: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word of sorted lists (``lists`` counts them up from any number): how
    many words of its list are near, the shorter one ``m`` long and their common prefix
    ``a`` to ``b`` - 1, and the place of the best (largest n, then smallest), or -1."""
    width = max(map(len, words))
    codes = np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    near = np.zeros(len(words), np.int64)
    best_n, best = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
    for left, right in near_pairs(codes, lens, lists):
        common = np.argmax(np.concatenate([codes[left] != codes[right], np.ones((len(left), 1), bool)], axis=1), axis=1)
        here = (common >= a[left]) & (common < b[left]) & (np.minimum(lens[left], lens[right]) == m[left])
        left, right = left[here], right[here]
        one, other = np.concatenate([left, right]), np.concatenate([right, left])
        order = np.lexsort((other, -n[other], one))
        one, other = one[order], other[order]
        heads = np.flatnonzero(np.r_[True, one[1:] != one[:-1]][: len(one)])
        near += np.bincount(one, minlength=len(words))
        one, other = one[heads], other[heads]
        better = (n[other] > best_n[one]) | ((n[other] == best_n[one]) & (best[one] >= 0) & (other < best[one]))
        one, other = one[better], other[better]
        best_n[one], best[one] = n[other], other
    return near, best


FOUND = "word string, n_near bigint, best_n bigint, best string"


def _compare_lists(keyed: DataFrame) -> DataFrame:
    """Rows (key, m, a, b, word, n) to a row per word and list that has near words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def done(table: pa.Table) -> pa.RecordBatch:
            words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
            changed = pc.not_equal(table.column("key")[1:], table.column("key")[:-1]).to_numpy()
            near, best = compare(words, n, np.cumsum(np.r_[0, changed]), *(table.column(c).to_numpy() for c in "mab"))
            at = np.flatnonzero(near)
            found = best[at]
            columns = pa.array([words[i] for i in at.tolist()], pa.string()), pa.array(near[at]), pa.array(n[found]), pa.array([words[i] for i in found.tolist()], pa.string())
            return pa.RecordBatch.from_arrays(list(columns), ["word", "n_near", "best_n", "best"])

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= TOGETHER:
                table = pa.concat_tables(held)
                same = pc.equal(table.column("key"), table.column("key")[-1]).to_numpy()
                whole = int(rows - np.count_nonzero(same))  # the last list may go on
                if whole:
                    yield done(table.slice(0, whole))
                    held, rows = [table.slice(whole)], rows - whole
        if rows:
            yield done(pa.concat_tables(held))

    rows = keyed.select("key", "m", "a", "b", "word", "n")
    return rows.repartition("key").sortWithinPartitions("key", "word").mapInArrow(run, FOUND)


def _key() -> Column:
    """A list's words share m, the window, the characters before it and those after."""
    tail = F.greatest(F.lit(0), F.col("m") - F.col("b"))
    after = F.expr("substring(word, length(word) - greatest(0, m - b) + 1)")
    return F.concat_ws(" ", "m", "a", "b", F.expr("substring(word, 1, a)"), F.when(tail > 0, after).otherwise(F.lit("")))


def lists(words: DataFrame, most: int = LIST, shortest: int = SHORTEST) -> list[DataFrame]:
    """Tables of (key, m, a, b, word, n) whose lists hold ``most`` words at most, or
    cannot be cut further.  What is looked at on the driver is whether any list is
    longer; a round halves all windows that are, so there are a few."""
    shorter = F.expr(f"filter(array(length(word), length(word) - 1), m -> m >= {shortest})")
    rows = words.select("word", "n", F.explode(shorter).alias("m"))
    half = "((m + 1) div 2)"
    cuts = F.expr(f"array(struct(0L as a, {half} as b), struct({half} as a, m + 1L as b))")
    rows = rows.select("word", "n", "m", F.explode(cuts).alias("w")).select("word", "n", F.col("m").cast("bigint").alias("m"), F.expr("cast(w.a as bigint) as a"), F.expr("cast(w.b as bigint) as b"))
    out = []
    while True:
        keyed = rows.withColumn("key", _key())
        long = keyed.filter("b - a > 1").groupBy("key").agg(F.count("*").alias("list_size")).filter(F.col("list_size") > most).select("key")
        long = written(long, "long-lists")
        if long.isEmpty():
            return [*out, keyed]
        out.append(lookup_join(keyed, long, ["key"], "left_anti", spread=["word"]))
        again = written(lookup_join(keyed, long, ["key"], "left_semi", spread=["word"]).drop("key"), "cut-anew")
        halves = F.expr("array(struct(a as a, (a + b) div 2 as b), struct((a + b) div 2 as a, b as b))")
        rows = again.select("word", "n", "m", F.explode(halves).alias("w")).select("word", "n", "m", "w.a", "w.b")


def near_words(words: DataFrame, most: int = LIST, shortest: int = SHORTEST) -> DataFrame:
    """Per word with near words: word, n_near, best_n and best (of largest n, then smallest)."""
    found = None
    for keyed in lists(words, most, shortest):
        part = _compare_lists(keyed)
        found = part if found is None else found.unionByName(part)
    first = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best"))).alias("first")
    sums = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first)
    return sums.select("word", "n_near", (-F.col("first.less")).alias("best_n"), F.col("first.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every (word, form): where following forms ends.  Each form is
    at least twice as frequent as its word, so there are no loops and chains are
    short; each round doubles the steps taken."""
    ahead = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = ahead.select(F.col("word").alias("root"), F.col("root").alias("next_root"))
        moved = written(ahead.join(on, "root", "left").select("word", F.coalesce("next_root", "root").alias("root"), F.col("next_root").isNotNull().alias("moved")), "roots")
        if moved.filter("moved").isEmpty():
            return moved.select("word", "root")
        ahead = moved.select("word", "root")


def variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, fewest: int = FEWEST, most: int = LIST
) -> DataFrame:
    """One row per word of the vocabulary: word, n, n_near (0 if none), form (its near
    word of largest n, then smallest, if at least twice as frequent, else null),
    form_n, and root (the end of its forms, itself if it has none).

    Null and empty texts have no words; a null id is hashed as no digits.  Repeated
    rows count as often as they are there.  No rows give no rows; other columns of
    ``docs`` are not looked at.  A text may be of any length."""
    words = written(vocabulary(docs, id_col, text_col, shortest, fewest), "vocabulary")
    near = near_words(words, most, shortest)
    clear = F.col("best_n") >= 2 * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(clear, F.col("best")).alias("form"), F.when(clear, F.col("best_n")).alias("form_n")
    )
    found = written(found, "near-words")
    ends = roots(found.filter("form is not null").select("word", "form"))
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
