"""Queries over streams of the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import at_exit, folder
from ..session import NOTES_SQL, ORIGIN, STEP, table
from ..streaming import mtp

#: Steps between notes up to which differences are counted.
HORIZON = 28


def streamed_mtp(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the MTPs of all notes whose events came as a stream, of vectors of up to HORIZON steps."""
    events = spark.readStream.schema(table(spark, d, "events").schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/events.parque[t]")  # a pattern: a plain path must be a folder
    onset = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - ORIGIN) / STEP).cast("long")
    notes = events.select(F.col("user_id").alias("piece_id"), onset.alias("onset"), (60 + F.floor("value").cast("long") % 24).alias("pitch"))
    notes = notes.withColumn("time", F.timestamp_micros(F.col("onset") * STEP + ORIGIN))
    increments = mtp.difference_counts(notes, slices=4, late="36500 days", horizon_ms=HORIZON * STEP // 1000)
    root = f"{folder(spark)}/cantus-{uuid.uuid4().hex}"
    q = increments.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/progress").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    at_exit(spark, root)
    return mtp.sizes(spark.read.schema(increments.schema).parquet(f"{root}/out"))


QUERIES = {"streamed_mtp": streamed_mtp}
ORACLE = {
    "streamed_mtp": f"""WITH {NOTES_SQL} SELECT a.piece_id, b.onset - a.onset AS d_onset, b.pitch - a.pitch AS d_pitch, count(*) AS size FROM notes a JOIN notes b ON a.piece_id = b.piece_id
  AND (a.onset < b.onset OR a.onset = b.onset AND a.pitch < b.pitch) AND b.onset - a.onset <= {HORIZON} GROUP BY 1, 2, 3""",
}
