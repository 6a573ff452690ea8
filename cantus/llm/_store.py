"""Intermediate tables in the folder all executors share, and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The largest side that is broadcast, in bytes (estimated from its rows); larger sides are shuffled.
BROADCAST_BYTES = 2 << 20

#: Bytes of one Arrow batch between Spark and Python, which bounds what a task holds of long texts at once.
BATCH_BYTES = 8 << 20


def lean(spark: SparkSession) -> None:
    """Bounds Arrow batches for what runs next in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a folder of this process, which only a local master may use:
    on a cluster executors could not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="cantus-"))
    return _OWN[0]


class Store:
    """Tables written once and read again, which cuts lineage. drop() deletes one that is no longer read; what is left
    when the session ends goes then, with the folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/cantus-{uuid.uuid4().hex}"
        self.n = 0
        lean(spark)
        fs, path = self._at(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._cantus_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            fs, path = self._at(df._cantus_path)
            fs.delete(path, True)


def small(side: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """side, marked for broadcast if rows * row_bytes is within the bound."""
    return F.broadcast(side) if rows * row_bytes <= BROADCAST_BYTES else side.hint("merge")


def total_bytes(df: DataFrame, col: str) -> tuple[int, int]:
    """Rows, and bytes of a binary column."""
    n, b = df.agg(F.count(F.lit(1)), F.sum(F.length(col))).first()
    return n, b or 0


def spread_join(rows: DataFrame, side: DataFrame, key: list[str], count: str, total: int) -> DataFrame:
    """rows joined to side, a table of distinct keys that says in column `count` how many of the `total` rows each has.

    Keys with more than a quarter of a partition's share of the rows are at most four times the partitions: they are
    broadcast, so that no task gathers their rows. The others are merged.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = side.where(F.col(count) > max(1, total // (4 * parts)))
    if not hot.take(1):
        return rows.join(side.hint("merge"), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    cold = side.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold.hint("merge"), key))
