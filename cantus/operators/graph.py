"""Connected components of many small graphs by joins, written between rounds to the shared folder, and work on a part of the pieces at a time."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local master gets a folder of its own; a cluster must name one that all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="cantus-"))
        root = _OWN[0]
    return root.rstrip("/")


#: Of each open `passing`, the tables written in it.
_PASSING: list[list[DataFrame]] = []
#: Whether Spark deletes a query's shuffle files as soon as it has ended, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, which cuts its lineage; it is deleted when the session ends, or with the `passing` that it is written in."""
    path = f"{folder(df.sparkSession)}/cantus-{uuid.uuid4().hex}"
    appended(df, path)
    return stored(df, path)


def appended(df: DataFrame, path: str) -> None:
    """Writes df to what is at path. Its shuffle files go at once."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("append").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, path: str) -> DataFrame:
    """The table at path, of df's columns."""
    spark = df.sparkSession
    at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cantus_path = path
    if _PASSING:
        _PASSING[-1].append(out)
    return out


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written meanwhile are deleted at the end, but for those that what it yields is called with."""
    own: list[DataFrame] = []
    kept: list[DataFrame] = []
    _PASSING.append(own)
    try:
        yield lambda table: kept.append(table) or table
    finally:
        _PASSING.pop()
        for table in own:
            if not any(table is k for k in kept):
                dropped(table)
        if _PASSING:
            _PASSING[-1].extend(kept)


#: Pairs of points that a part of the pieces holds for each core.
PAIRS = 1 << 21


def in_parts(notes: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """make(notes), which treats pieces apart, made for a part of the pieces at a time, so that its intermediate tables and shuffles are never there for all of them.

    Pieces are dealt by hash into as many parts as their pairs of points ask for; each part is a job over all cores. What make returns is written, and all else that it
    wrote is deleted before the next part.
    """
    spark, out = notes.sparkSession, None
    notes = written(notes)
    n = notes.groupBy("piece_id").agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n") / 2)).first()[0] or 0
    parts = int(n // (PAIRS * spark.sparkContext.defaultParallelism)) + 1
    path = f"{folder(spark)}/cantus-{uuid.uuid4().hex}"
    for k in range(parts):
        with passing():
            out = make(notes.where(F.pmod(F.xxhash64("piece_id"), F.lit(parts)) == k) if parts > 1 else notes)
            appended(out, path)
    dropped(notes)
    return stored(out, path)


def at_exit(spark: SparkSession, path: str) -> None:
    """Deletes what is at path when the session ends."""
    _file(spark, path, lambda fs, p: fs.deleteOnExit(p))


def dropped(table: DataFrame) -> None:
    """Deletes a table that `written` made and nothing reads any more."""
    _file(table.sparkSession, table._cantus_path, lambda fs, p: (fs.delete(p, True), fs.cancelDeleteOnExit(p)))


def _file(spark: SparkSession, path: str, do: Callable) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    do(p.getFileSystem(spark._jsc.hadoopConfiguration()), p)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (piece_id, node) and edges (piece_id, src, dst) to (piece_id, node, component), the least node reachable.

    Each round gives a node the least label among its neighbours' and its own, then follows the label's own label, so the
    number of rounds grows with the logarithm of the longest path.
    """
    both = edges.select("piece_id", "src", "dst").unionByName(edges.select("piece_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = written(both)
    held = label = written(nodes.select("piece_id", "node", F.col("node").alias("component")))
    while True:
        near = both.join(label.select("piece_id", F.col("node").alias("dst"), "component"), ["piece_id", "dst"]).groupBy("piece_id", F.col("src").alias("node")).agg(F.min("component").alias("near"))
        new = label.join(near, ["piece_id", "node"], "left").select("piece_id", "node", F.least("component", F.coalesce("near", "component")).alias("c"), F.col("component").alias("old"))
        jump = new.select("piece_id", F.col("node").alias("c"), F.col("c").alias("up"))
        new = written(new.join(jump, ["piece_id", "c"]).select("piece_id", "node", F.col("up").alias("component"), "old"))
        if not new.where("component <> old").take(1):
            return new.drop("old")
        dropped(held)
        held, label = new, new.drop("old")
