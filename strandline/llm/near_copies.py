"""Near copies by word shingles: all pairs with a Jaccard similarity of ``LIKE`` %.

If a set of n shingles shares ``LIKE`` % of the union with another, then, in any
common order of shingles, the two share one of their first n - ceil(LIKE % of n) + 1.
Only those are indexed, so no pair is missed.  The order puts shingles that a sample
finds common last; the sample thus bounds the work and never the result.

Texts are hashed once and kept as that prefix, their size and a *parity bitmap*: bit i
is the parity of the shingles that fall on i.  Two bitmaps differ in no more bits than
the sets have members that the other has not, so most pairs that meet in a posting are
ruled out there, exactly, at a sixteenth of the bytes of their sets.  The others are
verified on whole sets, a few of each text at a time; a pair that links already join
need not be.  One rule decides, whatever the order of work: links are all pairs that
are alike, and of each connected group the row with the smallest id stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.batches import give_back, small
from strandline.llm.components import components
from strandline.operators.skew import lookup_join
from strandline.session import scratch_scope, written

WORDS = 5
LIKE = 80
SAMPLE = 4_096
COMMON = 8  # texts of the sample
LISTED = 100_000  # common shingles that are known to all tasks, at most
POSTING = 2_048  # texts of a posting, in order of size, that are compared as a block
FIRST = 4  # pairs of a text that are verified first; four times as many in each round


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of fewer words, one of them all."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    pieces = zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist())
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in pieces), np.uint64))


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def _key(id_col: str, text_col: str) -> Column:
    """What tells a row from others, null ids included."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(_text(text_col)).alias("tag"))


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """node and its shingles, of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 64):
            sets = [pa.array(shingles(t, words).view(np.int64)) for t in batch.column(1).to_pylist()]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)], dtype=np.int32), pa.concat_arrays(sets))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["node", "hashes"])

    return texts.mapInArrow(run, "node bigint, hashes array<bigint>")


def _common(docs: DataFrame, text_col: str, words: int) -> np.ndarray:
    """Sorted hashes of the shingles that most texts of a sample hold."""
    texts = docs.select(F.xxhash64(_text(text_col)).alias("node"), _text(text_col).cast("binary").alias("text"))
    share = min(1.0, SAMPLE / max(1, docs.count()))
    sampled = texts.filter(F.pmod(F.col("node"), F.lit(1_000_003)) < int(1_000_003 * share))
    counts = _sets(sampled, words).select(F.explode("hashes").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    listed = counts.filter(F.col("n") >= COMMON).orderBy(F.desc("n"), "key").limit(LISTED)
    return np.sort(listed.select("key").toPandas().key.to_numpy(np.int64).view(np.uint64))


def first_shingles(hashes: np.ndarray, common: np.ndarray, like: int = LIKE) -> np.ndarray:
    """Those of which a similar text has at least one among its own."""
    size = len(hashes) - -(-like * len(hashes) // 100) + 1 if len(hashes) else 0
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)  # common is sorted and long
        last = common[at] == hashes
        hashes = np.concatenate([hashes[~last], hashes[last]])
    return hashes[:size]


def parity(hashes: np.ndarray) -> bytes:
    """A bitmap of four bits a shingle, 64 at least, rounded up to a power of two."""
    bits = 64
    while bits < 4 * len(hashes):
        bits *= 2
    odd = np.bincount((hashes >> np.uint64(8)) & np.uint64(bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bitmaps: list[bytes], size: int) -> np.ndarray:
    """Bitmaps as rows of ``size`` bytes: halves of longer ones are added, which is
    what their parity would be at that length."""
    out = np.empty((len(bitmaps), size // 8), np.uint64)
    for i, bitmap in enumerate(bitmaps):
        row = np.frombuffer(bitmap, np.uint64)
        while len(row) > size // 8:
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
        out[i] = row
    return out


INDEX = "size int, keys array<bigint>, bitmap binary"


def _index(rows: DataFrame, common: np.ndarray, words: int, like: int) -> DataFrame:
    """Per row of (key, text): key, size, prefix and bitmap.  One scan."""
    shared = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 256):
            sets = [shingles(t, words) for t in batch.column(1).to_pylist()]
            keys = [first_shingles(s, shared.value, like).view(np.int64) for s in sets]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, keys)], dtype=np.int32), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int32()), lists, pa.array([parity(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "size", "keys", "bitmap"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, {INDEX}")


def _postings(index: DataFrame) -> DataFrame:
    """(posting, node, size, place) of the postings of two texts or more, each in order
    of size.  A row is told from its neighbours; no posting is held as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place = None, 0  # the last row, which waits for the one after it; its place

        def out(rows: np.ndarray, following: int | None) -> pa.RecordBatch:
            nonlocal place
            posting = rows[0]
            new = np.r_[place == 0, posting[1:] != posting[:-1]]
            starts = np.flatnonzero(new)
            places = np.arange(len(posting)) - np.repeat(starts, np.diff(np.r_[starts, len(posting)])) if new[0] else None
            if places is None:
                starts = np.r_[0, starts]
                places = np.arange(len(posting)) - np.repeat(starts, np.diff(np.r_[starts, len(posting)]))
                places[: starts[1] if len(starts) > 1 else len(posting)] += place
            last = following is None or following != posting[-1]
            place = 0 if last else int(places[-1]) + 1
            alone = (places == 0) & np.r_[posting[1:] != posting[:-1], last]
            columns = [*rows[:, ~alone], places[~alone]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["posting", "node", "size", "place"])

        for batch in batches:
            if batch.num_rows:
                rows = np.array([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
                if held is not None:
                    rows = np.concatenate([held, rows], axis=1)
                if rows.shape[1] > 1:
                    yield out(rows[:, :-1], int(rows[0, -1]))
                held = rows[:, -1:]
        if held is not None:
            yield out(held, None)
        give_back()

    rows = index.select(F.explode("keys").alias("posting"), "node", F.col("size").cast("bigint").alias("size"))
    rows = rows.repartition("posting").sortWithinPartitions("posting", "size", "node")
    return rows.mapInArrow(run, "posting bigint, node bigint, size bigint, place bigint")


def _blocks(members: DataFrame, like: int) -> DataFrame:
    """Each row with the pairs of blocks (one, other) of its posting that it is compared
    in.  A posting of one block has one; in a longer one, blocks whose sizes are too far
    apart do not meet."""
    placed = members.withColumn("block", F.expr(f"place div {POSTING}"))
    ends = written(placed.groupBy("posting", "block").agg(F.min("size").alias("lo"), F.max("size").alias("hi"), F.count("*").alias("n")), "blocks")
    long = written(ends.filter("block > 0").select("posting").distinct(), "long-postings")
    if long.isEmpty():
        return members.select("posting", F.lit(0).cast("bigint").alias("one"), F.lit(0).cast("bigint").alias("other"), F.lit(0).cast("bigint").alias("block"), "node", "size")
    parts = ends.join(long, "posting")
    left, right = (parts.select("posting", F.col("block").alias(b), F.col(e).alias(e)) for b, e in (("one", "hi"), ("other", "lo")))
    meets = left.join(right, "posting").filter((F.col("one") <= F.col("other")) & (F.col("hi") * 100 >= F.col("lo") * like))
    sides = F.array_distinct(F.array("one", "other"))
    meets = written(meets.select("posting", "one", "other", F.explode(sides).alias("block")), "block-pairs")
    short = lookup_join(placed, long, ["posting"], "left_anti", hot=[]).withColumns({"one": F.col("block"), "other": F.col("block")})
    every = short.unionByName(placed.join(meets, ["posting", "block"]), allowMissingColumns=True)
    return every.select("posting", "one", "other", "block", "node", "size")


def near_in(sizes: np.ndarray, bitmaps: list[bytes], first: np.ndarray, like: int = LIKE) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs that may be alike: none that is alike is missing.  Rows come in
    order of size; if ``first`` marks one of two blocks, only pairs of both count."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    lengths = np.fromiter(map(len, bitmaps), np.int64, len(bitmaps))
    last = np.searchsorted(sizes, sizes * 100 // like, side="right")
    for length in np.unique(lengths):
        here = np.flatnonzero(lengths == length)
        lo, hi = here[0], int(last[here[-1]])  # sizes grow, and lengths with them
        rows = folded(bitmaps[lo:hi], int(length))
        for at in here.tolist():
            b = np.arange(at + 1, last[at])
            b = b[first[b] != first[at]] if first.any() and not first.all() else b
            if len(b):
                both = sizes[at] + sizes[b]
                most = both - 2 * -(-like * both // (100 + like))  # members that only one of two alike has
                b = b[np.bitwise_count(rows[b - lo] ^ rows[at - lo]).sum(axis=1) <= most]
                left.append(np.full(len(b), at))
                right.append(b)
    return np.concatenate(left), np.concatenate(right)


def _candidates(blocks: DataFrame, like: int) -> DataFrame:
    """Distinct pairs (a < b) of nodes that bitmaps do not rule out, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = [], None

        def done() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).sort_by([("size", "ascending"), ("node", "ascending")])
            nodes, block = rows.column("node").to_numpy(), rows.column("block").to_numpy()
            a, b = near_in(rows.column("size").to_numpy(), rows.column("bitmap").to_pylist(), block == block.max(), like)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(nodes[a], nodes[b])), pa.array(np.maximum(nodes[a], nodes[b]))], ["a", "b"])

        for batch in batches:
            keys = np.array([batch.column(i).to_numpy() for i in range(3)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                key = tuple(keys[:, lo].tolist())
                if held and key != group:
                    yield done()
                    held = []
                group = key
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield done()
        give_back()

    rows = blocks.select("posting", "one", "other", "block", "node", "size", "bitmap")
    rows = rows.repartition("posting", "one", "other").sortWithinPartitions("posting", "one", "other")
    return rows.mapInArrow(run, "a bigint, b bigint").filter("a <> b").distinct()


def _alike(pairs: DataFrame, sets: DataFrame, like: int) -> DataFrame:
    """The pairs whose whole sets are alike."""
    left, right = (sets.select(F.col("node").alias(x), F.col("hashes").alias(f"of_{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return both.filter(shared * (100 + like) >= (F.size("of_a") + F.size("of_b")) * like).select("a", "b")


def _groups(candidates: DataFrame, sets: DataFrame, like: int) -> DataFrame | None:
    """(node, least) of the groups that links join.  In each round the first pairs of
    every text are verified, until every other pair lies within a group."""
    left, links, groups, most = candidates, None, None, FIRST
    while not left.isEmpty():
        rank = F.row_number().over(Window.partitionBy("a").orderBy("b"))
        now = written(left.withColumn("nth", rank).filter(F.col("nth") <= most).drop("nth"), "pairs-now")
        found = written(_alike(now, sets, like), "alike")
        links = found if links is None else links.unionByName(found)
        groups = written(components(links), "groups")
        of = lambda x: groups.select(F.col("node").alias(x), F.col("least").alias(f"least_{x}"))  # noqa: E731,B023
        open_ = left.join(now, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
        apart = F.coalesce("least_a", "a") != F.coalesce("least_b", "b")
        left = written(open_.filter(apart).select("a", "b"), "pairs-left")
        most *= 4
    return groups


def drop_similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, like: int = LIKE, among: DataFrame | None = None
) -> DataFrame:
    """``docs`` with one row of each group that pairs with a Jaccard similarity of
    ``like`` % or more join: that with the smallest id (null last, then by a hash of
    the text).  ``among`` (key: id and hash, see ``key_of``) names the rows that count;
    others are left out.

    Null, empty and wordless texts have no shingles and are unlike all.  Rows with the
    same id and text are one, and one of them stays.  No rows give no rows; other
    columns are carried along whatever their names."""
    spark = docs.sparkSession
    with scratch_scope(spark):
        rows = docs.select(_key(id_col, text_col).alias("key"), _text(text_col).cast("binary").alias("text"))
        if among is not None:
            rows = lookup_join(rows, among, ["key"], "left_semi", hot=[])
        index = _index(rows, _common(docs, text_col, words), words, like)
        index = written(index.withColumn("node", F.monotonically_increasing_id()), "shingle-index")
        members = written(_postings(index), "postings")
        blocks = _blocks(members, like)
        blocks = blocks.join(index.select("node", "bitmap"), "node")
        candidates = written(_candidates(blocks, like), "candidates")
        nodes = candidates.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = written(nodes.join(index.select("node", "key"), "node"), "candidate-rows")
        one = wanted.groupBy("key").agg(F.min("node").alias("node"))  # repeated rows have one text
        texts = lookup_join(rows, one, ["key"]).groupBy("node").agg(F.first("text").alias("text"))
        sets = _sets(texts.select("node", "text"), words)
        sets = written(wanted.join(one.withColumnRenamed("node", "of"), "key").select("node", "of").join(sets.withColumnRenamed("node", "of"), "of").select("node", "hashes"), "sets")
        groups = _groups(candidates, sets, like)
        own = F.struct(F.col("key.id").isNull().alias("no_id"), F.col("key.id").alias("id"), F.col("key.tag").alias("tag"))
        keyed = index.select("node", "key", own.alias("own"))
        if groups is None:
            stays = keyed.select("key").distinct()
        else:
            rooted = keyed.join(groups, "node", "left").withColumn("least", F.coalesce("least", "node"))
            best = rooted.groupBy("least").agg(F.min("own").alias("best"))
            stays = best.select(F.struct(F.col("best.id").alias("id"), F.col("best.tag").alias("tag")).alias("key")).distinct()
        stays = written(stays, "near-stays", outlives=True)
        repeated = written(index.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "near-repeated", outlives=True)
    whole = docs.select(_key(id_col, text_col).alias("key"), F.struct(*docs.columns).alias("row"))
    kept = lookup_join(whole, stays, ["key"], "left_semi", hot=[])
    if not repeated.isEmpty():
        again = lookup_join(kept, repeated, ["key"], "left_semi").dropDuplicates(["key"])
        kept = lookup_join(kept, repeated, ["key"], "left_anti").unionByName(again)
    return kept.select("row.*")


def key_of(id_col: Column, tag: Column) -> Column:
    """The key of a row from its id and the xxhash64 of its text."""
    return F.struct(id_col.alias("id"), tag.alias("tag"))
