"""Nearest neighbours by cross-polytope hashing, with exact reranking.

Each table turns a unit vector by three rounds of random signs and a fast Hadamard
transform and takes the nearest signed axis (several axes in turn for large
tables).  A query visits its likeliest buckets in each table; how many is measured
on a bounded sample of queries, whose neighbours are found by brute force, so that
``RECALL`` of them are met.  Candidates are compared exactly, on the vectors given,
bucket by bucket: a task holds at most about ``PIECE`` vectors of a bucket and lets
the bucket's queries pass, so pairs are never rows.

Equal vectors are indexed once, with their smallest ids.  A query that meets fewer
rows than asked for visits all buckets of one table, which hold every row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import written

TABLES = 4
BUCKET = 400  # rows a bucket has on average, about: decides how many axes a hash takes
PIECE = 4096
SAMPLE = 64  # queries that are also searched by brute force
RECALL = 0.96
SEED = 20


@lru_cache(maxsize=64)
def signs(size: int, table: int, axis: int) -> np.ndarray:
    rng = np.random.default_rng([SEED, size, table, axis])
    return rng.choice(np.array([-1.0, 1.0]), (3, size))


def rotated(x: np.ndarray, table: int, axis: int) -> np.ndarray:
    """Pseudo-random rotation of rows, padded to a power of two."""
    size = 1 << max(0, (x.shape[1] - 1)).bit_length()
    y = np.zeros((len(x), size))
    y[:, : x.shape[1]] = x
    for flip in signs(size, table, axis):
        y = y * flip
        half = 1
        while half < size:
            y = y.reshape(len(x), -1, 2, half)
            y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), size)
            half *= 2
        y /= math.sqrt(size)
    return y


def scores(x: np.ndarray, table: int, axes: int) -> list[np.ndarray]:
    """For each axis in turn, how near each signed axis is to each row."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    turned = [rotated(unit, table, a) for a in range(axes)]
    return [np.concatenate([t, -t], axis=1) for t in turned]


def codes(x: np.ndarray, table: int, axes: int) -> np.ndarray:
    """The bucket of each row."""
    code = np.zeros(len(x), np.int64)
    for near in scores(x, table, axes):
        code = code * near.shape[1] + near.argmax(axis=1)
    return code


def probes(x: np.ndarray, table: int, axes: int, count: int) -> np.ndarray:
    """The ``count`` likeliest buckets of each row, best first."""
    out = []
    for row in zip(*scores(x, table, axes)):
        best, loss = np.zeros(1, np.int64), np.zeros(1)
        for near in row:
            order = np.argsort(-near, kind="stable")[:count]
            both = (loss[:, None] + (near.max() - near[order])[None]).ravel()
            keys = (best[:, None] * len(near) + order[None]).ravel()
            first = np.argsort(both, kind="stable")[:count]
            best, loss = keys[first], both[first]
        out.append(best)
    return np.array(out)


def _vectors(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(queries: np.ndarray, rows: np.ndarray, first_ids: np.ndarray, count: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and squared distances of the ``count`` nearest rows of each query,
    ties by the smaller first id; in double precision, in bounded pieces."""
    out = []
    step = max(1, (1 << 22) // max(1, rows.size))
    for at in range(0, len(queries), step):
        square = ((queries[at : at + step, None] - rows[None]) ** 2).sum(axis=2)
        for line in square:
            places = np.arange(len(line))
            if len(line) > count:
                places = np.flatnonzero(line <= np.partition(line, count - 1)[count - 1])
            places = places[np.lexsort((first_ids[places], line[places]))][:count]
            out.append((places, line[places]))
    return out


def _sound(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vec of the rows that take part: not null, not zero, all
    components finite, and of the most common length."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vec"))
    sound = sound.filter(F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0))
    usual = sound.groupBy(F.size("vec").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    return sound.filter(F.size("vec") == (usual.length if usual else 0))


PAIRS = "query bigint, found bigint, square double, first_id bigint"


def _pair_batch(pairs: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*pairs)) or [()] * 4
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["query", "found", "square", "first_id"])


def _best(pairs: DataFrame, count: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy("square", F.col("first_id").asc_nulls_first(), "found"))
    return pairs.withColumn("place", rank).filter(F.col("place") <= count).drop("place")


def _visits(stored: DataFrame, asked: DataFrame, tables: int, axes: int, count: int, k: int) -> DataFrame:
    """Pairs (query, found, square, first_id): the ``k`` nearest vectors of each
    bucket piece that a query visits."""
    spread = "key bigint, gid bigint, first_id bigint, vec array<double>"

    def deal(many: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _vectors(batch, "vec")
                for table in range(tables if len(x) else 0):
                    found = probes(x, table, axes, many) if many else codes(x, table, axes)[:, None]
                    own = np.repeat(np.arange(len(x)), found.shape[1])
                    for at in range(0, len(own), 4096):
                        rows = own[at : at + 4096]
                        keys = found.ravel()[at : at + 4096] * tables + table
                        columns = [pa.array(keys), batch.column("gid").take(pa.array(rows)), batch.column("first_id").take(pa.array(rows)), batch.column("vec").take(pa.array(rows))]
                        yield pa.RecordBatch.from_arrays(columns, ["key", "gid", "first_id", "vec"])

        return run

    columns = ["gid", "first_id", F.col("vec").cast("array<double>").alias("vec")]
    index = stored.select(*columns).mapInArrow(deal(0), spread)
    asking = asked.select(*columns).mapInArrow(deal(count), spread)
    sizes = index.groupBy("key").agg(F.count("*").alias("n"))
    sizes = written(sizes.select("key", F.ceil(F.col("n") / PIECE).cast("int").alias("pieces")), "bucket-sizes")
    index = index.join(sizes, "key").withColumn("piece", F.pmod(F.xxhash64("gid"), F.col("pieces")).cast("int"))
    asking = asking.join(sizes, "key").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    met = index.withColumn("kind", F.lit(0)).unionByName(asking.withColumn("kind", F.lit(1)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        gids = firsts = np.zeros(0, np.int64)
        nulls, rows = np.zeros(0, bool), np.zeros((0, 1))
        for batch in batches:
            keys, pieces, kinds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "piece", "kind"))
            own = batch.column("gid").to_numpy(zero_copy_only=False)
            first = batch.column("first_id").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            x = _vectors(batch, "vec")
            new = (keys[1:] != keys[:-1]) | (pieces[1:] != pieces[:-1]) | (kinds[1:] != kinds[:-1])
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(keys)]
            pairs: list[tuple] = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if (keys[a], pieces[a]) != at:
                    at, held = (keys[a], pieces[a]), []
                    rows = np.zeros((0, x.shape[1]))
                if kinds[a] == 0:
                    held.append((own[a:b], first[a:b], x[a:b]))
                    continue
                if held:
                    gids, firsts, rows = (np.concatenate(c) if not len(rows) else np.concatenate([o, *c]) for o, c in zip((gids, firsts, rows), zip(*held)))
                    held = []
                if len(rows):
                    for query, (places, squares) in zip(own[a:b].tolist(), nearest(x[a:b], rows, firsts, k)):
                        pairs += zip([query] * len(places), gids[places].tolist(), squares.tolist(), firsts[places].tolist())
            yield _pair_batch(pairs)

    dealt = met.select("key", "piece", "kind", "gid", "first_id", "vec").repartition("key", "piece")
    return dealt.sortWithinPartitions("key", "piece", "kind").mapInArrow(compare, PAIRS).distinct()


def brute(stored: DataFrame, asked: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """The ``k`` nearest of a bounded list of (gid, vector), by one scan."""
    gids, x = [g for g, _ in asked], np.array([v for _, v in asked], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("gid").to_pylist()
            first = batch.column("first_id").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            found = nearest(x, _vectors(batch, "vec"), first, k) if own else []
            yield _pair_batch([(q, own[p], s, int(first[p])) for q, (ps, ss) in zip(gids, found) for p, s in zip(ps.tolist(), ss.tolist())])

    return _best(stored.select("gid", "first_id", "vec").mapInArrow(run, PAIRS), k)


def visits_needed(stored: DataFrame, asked: DataFrame, axes: int, width: int, k: int) -> int:
    """How many buckets a table are visited, so that of a sample of queries
    ``RECALL`` of the true neighbours are met."""
    all_buckets = width**axes
    sample = asked.orderBy(F.xxhash64("gid"), "gid").limit(SAMPLE).select("gid", "vec").collect()
    true = brute(stored, [(r.gid, r.vec) for r in sample], k + 1).filter("query <> found").select("query", F.col("found").alias("gid"))
    pairs = true.join(stored.select("gid", "vec"), "gid").select("query", "vec").collect()  # SAMPLE times k at most
    if not pairs:
        return 1
    mine = {r.gid: r.vec for r in sample}
    x, y = np.array([mine[p.query] for p in pairs], np.float64), np.array([p.vec for p in pairs], np.float64)
    code = [codes(y, t, axes) for t in range(TABLES)]
    many = 1
    while many < all_buckets:
        met = np.zeros(len(pairs), bool)
        for table in range(TABLES):
            met |= (probes(x, table, axes, many) == code[table][:, None]).any(axis=1)
        if met.mean() >= RECALL:
            break
        many = min(all_buckets, many + max(1, many // 4))
    return many


def nearest_rows(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` for each row of ``queries`` (rows of
    ``vectors``), by Euclidean distance: query_id, rank (from 1), vec_id, score;
    nearest first, ties by the smaller id.

    A row with the query's own id is no neighbour.  Rows repeated with id and vector
    count once; an id with several vectors is several queries.  Vectors that are null, zero, of another length than most, or that
    hold null or non-finite components take no part, as rows or queries; a null id
    takes part as a row and sorts first among ties.  No rows give no rows.
    """
    sound = _sound(vectors, id_col, vector_col)
    near_ids = Window.partitionBy("vec").orderBy(F.col("vec_id").asc_nulls_first())
    few = sound.withColumn("place", F.dense_rank().over(near_ids)).filter(F.col("place") <= k + 1)  # trimmed before the shuffle
    ids = F.array_sort(F.collect_set(F.coalesce("vec_id", F.lit(-(1 << 63)))))
    stored = few.groupBy("vec").agg(ids.alias("ids")).withColumn("gid", F.monotonically_increasing_id())
    first = F.nullif(F.element_at("ids", 1), F.lit(-(1 << 63)))
    stored = written(stored.select("gid", first.alias("first_id"), "ids", "vec"), "vectors")
    wanted = _sound(queries, id_col, vector_col).filter(F.col("vec_id").isNotNull()).distinct()
    wanted = written(wanted.join(stored.select("vec", "gid"), "vec").select(F.col("vec_id").alias("query_id"), "gid"), "queries")
    asked = written(stored.join(wanted.select("gid").distinct(), "gid", "left_semi"), "query-vectors")
    n, length = stored.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not n or asked.isEmpty():
        return _ranked(stored.sparkSession.createDataFrame([], PAIRS), stored, wanted, k).drop("gid")
    width = 2 << max(0, length - 1).bit_length()
    axes = max(1, round(math.log(max(1, n / BUCKET)) / math.log(width)))
    many = visits_needed(stored, asked, axes, width, k)
    pairs = _best(_visits(stored, asked, TABLES, axes, many, k + 1), k + 1)
    result = written(_ranked(pairs, stored, wanted, k), "neighbours")

    rows_in_all = sound.select("vec_id").distinct().count()
    full = result.groupBy("query_id", "gid").agg(F.count("*").alias("n")).filter(F.col("n") >= min(k, rows_in_all - 1))
    short = wanted.join(full.select("query_id", "gid"), ["query_id", "gid"], "left_anti")
    if rows_in_all < 2 or short.isEmpty():
        return result.drop("gid")
    short = written(short, "short")
    again = stored.join(short.select("gid").distinct(), "gid", "left_semi")
    pairs = _best(_visits(stored, again, 1, axes, width**axes, k + 1), k + 1)
    result = result.join(short, ["query_id", "gid"], "left_anti").unionByName(_ranked(pairs, stored, short, k))
    return result.drop("gid")


def _ranked(pairs: DataFrame, stored: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Vectors found to rows found, without the query's own."""
    rows = pairs.join(stored.select(F.col("gid").alias("found"), "ids"), "found")
    rows = rows.select(F.col("query").alias("gid"), "square", F.explode("ids").alias("id"))
    rows = wanted.join(rows, "gid").filter(F.col("id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id", "gid").orderBy("square", "id"))
    rows = rows.withColumn("rank", rank).filter(F.col("rank") <= k)
    return rows.select("query_id", "gid", "rank", F.nullif("id", F.lit(-(1 << 63))).alias("vec_id"), F.sqrt("square").alias("score"))
