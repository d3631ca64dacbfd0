"""Session set-up and the shared working folder.

Iterative operators and the prefix sum write intermediate tables.  They go to
the folder the cluster names in ``spark.checkpoint.dir``, so a lost executor
costs a re-read and never the whole lineage.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "strandline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
        "spark.sql.python.filterPushdown.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="strandline-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, label: str) -> str:
    """A new, unused path below the working folder."""
    path = f"{work_dir(spark)}/{label}-{uuid4().hex}"
    for paths in _SCOPES:
        paths.append(path)
    return path


_SCOPES: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes the intermediate tables made inside when it ends, after errors too.
    Write or collect results inside: what is still lazy reads those tables."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.remove(paths)
        for path in paths:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, label: str, outlives: bool = False) -> DataFrame:
    """``df`` stored as parquet and read back: cuts lineage, fixes the rows.  What
    ``outlives`` the scope it is made in is left by it."""
    path = f"{work_dir(df.sparkSession)}/{label}-{uuid4().hex}" if outlives else scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class BucketedTable:
    """A table hashed on its key columns once, so later joins and groupings on
    those columns read it without a shuffle.  ``add`` appends rows in the same
    layout.  ``close`` takes the name out of the catalog; DataFrames already
    made from the table keep working, as the files stay."""

    def __init__(self, spark: SparkSession, label: str, keys: tuple[str, ...], buckets: int):
        self.spark, self.keys, self.buckets = spark, keys, buckets
        self.path = scratch(spark, label)
        self.name = "strandline_" + uuid4().hex

    def add(self, df: DataFrame, spread: bool = True) -> BucketedTable:
        """Append ``df``.  ``spread=False`` when each task already holds one key value."""
        if spread:
            df = df.repartition(self.buckets, *self.keys)
        (
            df.write.mode("append")
            .bucketBy(self.buckets, *self.keys)
            .option("path", self.path)
            .format("parquet")
            .saveAsTable(self.name)
        )
        return self

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
