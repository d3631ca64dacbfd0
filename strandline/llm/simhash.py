"""SimHash near-duplicates by a byte-position inverted index.

Fingerprints that differ in at most 3 of 64 bits differ in at most 3 of 8 bytes,
so a linked pair shares at least 5 positional bytes.  Of any 5 positions of 8,
three lie in one half, so postings hold three positional bytes of one half: 8
postings a fingerprint, and every pair with 5 shared bytes meets in one of them.
Within a posting the shared positional bytes of each pair are tallied; pairs that
reach 5 are verified by their differing bits.

A posting of more than ``POSTING`` distinct fingerprints is never compared pair by
pair.  Its members go to finer postings of 5 positional bytes, which already hold
the least number of matches.  What is left differs in three bytes, so at most 2^24
fingerprints share one, and each looks up the 2,324 values within 3 bits of its
own.  Only distinct fingerprints are indexed, and each posting yields a spanning
forest of its links, so copies and clusters give no pairs by the square.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.batches import small
from strandline.llm.components import components
from strandline.operators.skew import lookup_join
from strandline.session import written

WORDS = 3
BITS = 3
POSTING = 2_000
#: Three positions of one half: among any five of the eight there are such three.
COARSE = [c for half in (range(4), range(4, 8)) for c in combinations(half, 3)]
FINE = list(combinations(range(8), 5))


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash of word shingles; 0 without words."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) < words:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist())]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):  # a bounded piece of a long text at a time
        piece = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(piece, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, tag (a hash of the text) and fp (the 64 bits as a signed long) of
    every row; null and empty texts, and texts without words, have fp 0.  One scan,
    no shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tag"), text.cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            fps = [signed(fingerprint(t, words)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "tag", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, tag bigint, fp bigint")


def _postings(fps: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """One row per fingerprint and set of positions: key holds the set's number
    and the bytes at its positions."""
    keys = []
    for number, places in enumerate(sets):
        key = F.lit(number).cast("bigint")
        for place in places:
            byte = F.shiftrightunsigned("fp", 8 * place).bitwiseAND(F.lit(255))
            key = F.shiftleft(key, 8).bitwiseOR(byte)
        keys.append(key)
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _apart(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shared positional bytes and differing bits of two arrays."""
    x = np.ascontiguousarray(a ^ b)
    return (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=-1), np.bitwise_count(x)


def _forest(count: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Links that join what the pairs join."""
    parent = list(range(count))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for left, right in pairs:
        for a, b in zip(left.tolist(), right.tolist()):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                links.append((a, b))
    return links


def counted_pairs(fps: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (places in ``fps``) that share enough positional bytes, verified."""
    for at in range(len(fps) - 1):
        shared, differ = _apart(fps[at], fps[at + 1 :])
        near = np.flatnonzero((shared >= 8 - bits) & (differ <= bits))
        if len(near):
            yield np.full(len(near), at), near + at + 1


@lru_cache(maxsize=8)
def flips(places: tuple[int, ...], bits: int = BITS) -> np.ndarray:
    """All values with at most ``bits`` bits set, within the bytes at ``places``."""
    each = [np.uint64(1 << (8 * p + b)) for p in places for b in range(8)]
    return np.array([np.bitwise_or.reduce(c) for n in range(1, bits + 1) for c in combinations(each, n)], np.uint64)


def looked_up_pairs(fps: np.ndarray, places: tuple[int, ...], bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same among sorted fingerprints that differ only at ``places``, by
    looking up every value near each."""
    for flip in flips(places, bits):
        other = fps ^ flip
        at = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
        found = np.flatnonzero((fps[at] == other) & (other > fps))
        if len(found):
            yield found, at[found]


def _links(fps: np.ndarray, places: tuple[int, ...] | None, bits: int) -> list[tuple[int, int]]:
    fps = np.sort(fps)
    pairs = counted_pairs(fps, bits) if places is None or len(fps) < len(flips(places, bits)) else looked_up_pairs(fps, places, bits)
    return [(int(fps[a].view(np.int64)), int(fps[b].view(np.int64))) for a, b in _forest(len(fps), pairs)]


def _posting_links(postings: DataFrame, sets: list[tuple[int, ...]] | None, bits: int) -> DataFrame:
    """Verified links within each key of ``postings`` (key, fp), a key at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done(key: int, held: list[np.ndarray]) -> list[tuple[int, int]]:
            fps = np.concatenate(held)
            places = None if sets is None else tuple(p for p in range(8) if p not in sets[key >> 40])
            return _links(fps, places, bits) if len(fps) > 1 else []

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]).tolist()
            links = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if held and keys[a] != key:
                    links += done(key, held)
                    held = []
                key = int(keys[a])
                held.append(fps[a:b])
            yield _link_batch(links)
        if held:
            yield _link_batch(done(key, held))

    return postings.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint")


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    columns = zip(*links) if links else ([], [])
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["a", "b"])


def fingerprint_links(fps: DataFrame, bits: int = BITS, posting: int = POSTING) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that join all those
    within ``bits`` bits of each other: a spanning forest of each posting's links."""
    if bits != BITS:
        raise ValueError("the positions indexed are chosen for 3 bits")
    postings = _postings(fps, COARSE)
    counts = written(postings.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "postings")
    few, many = counts.filter(F.col("n") <= posting).select("key"), counts.filter(F.col("n") > posting).select("key")
    links = _posting_links(lookup_join(postings, few, ["key"], "left_semi", measure=False, hot=[]), None, bits)
    if many.isEmpty():
        return links
    crowded = lookup_join(postings, many, ["key"], "left_semi", spread=["fp"]).select("fp").distinct()
    finer = _postings(written(crowded, "crowded"), FINE)
    return links.unionByName(_posting_links(finer, FINE, bits))


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, tag, fp, and best: id and tag of the row with the smallest id
    (null last) of the component."""
    rows = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag"))
    own = written(rows.groupBy("fp").agg(first.alias("first")), "distinct-fingerprints")
    joined = written(components(fingerprint_links(own.select("fp"))), "components")
    rooted = own.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("least", F.coalesce("least", "fp"))
    named = rooted.groupBy("least").agg(F.min("first").alias("best"))
    ids = written(rooted.join(named, "least").select("fp", "best"), "component-ids")
    return rows.join(ids, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (the smallest id
    reachable over links of at most 3 differing bits, itself included).

    Null, empty and wordless texts have fingerprint 0, which links like any other.
    A null id is the smallest only where a component has no other.  No rows give
    no rows; other columns of ``docs`` are not looked at.
    """
    found = _grouped(docs, id_col, text_col, words)
    return found.select("doc_id", "fp", F.col("best.doc_id").alias("component_id"))


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(key) of the row of each component with the smallest id (null last): its id and
    the xxhash64 of its text, as a struct, so that null ids are equal."""
    best = _grouped(docs, id_col, text_col, words).select(F.col("best.doc_id").alias("id"), F.col("best.tag").alias("tag"))
    return written(best.distinct().select(F.struct("id", "tag").alias("key")), "near-representatives")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id (null
    last); of rows repeated whole, one.  Other columns are carried along whatever
    their names."""
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tag"))
    rows = docs.select(key.alias("key"), F.struct(*docs.columns).alias("row"))
    kept = lookup_join(rows, representatives(docs, id_col, text_col, words), ["key"], "left_semi", hot=[])
    return kept.dropDuplicates(["key"]).select("row.*")
