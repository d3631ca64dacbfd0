"""Connected components of a link table, in rounds that each write a table.

A task first joins its own links by union-find, which leaves at most one link per
node it saw.  Then large stars and small stars alternate (Kiveris and others,
2014) until every node is linked to the smallest node it reaches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import written

ROUNDS = 60  # far more than graphs need; beyond it something is wrong


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch, links of each node to the smallest it reaches in the batch."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        nodes = [x for x in parent if root(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["a", "b"])


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest node around it: those
    above the node (large), or the node and those below it (small)."""
    if large:
        links = links.union(links.select("b", "a"))
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    near = links.join(least.withColumn("m", F.least("a", "m")), "a")
    if large:
        return near.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    both = near.select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("x"))
    return both.select("x.a", F.col("x.m").alias("b")).filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long, either order, repeats and loops allowed) to node and
    ``least``, the smallest node it reaches; nodes without links are not in it, nor
    is the smallest node itself.  Hot nodes are reduced by partial minima, and the
    joins on them are left to adaptive execution to split."""
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = written(links.mapInArrow(forest, "a bigint, b bigint"), "links")
    shape = None
    for _ in range(ROUNDS):
        if links.isEmpty():
            break
        links = written(_star(_star(links, True), False), "links")
        now = links.agg(F.count("*"), F.countDistinct("a"), F.sum(F.col("b") % 1_000_003), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if now == shape:
            return links.select(F.col("a").alias("node"), F.col("b").alias("least"))
        shape = now
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("least"))
