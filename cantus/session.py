"""Session settings and the tables that the library's operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "cantus", cpus: int | str = "*", partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Microseconds of the grid's origin (2024-01-01 UTC) and of one step (six hours).
ORIGIN, STEP = 1704067200000000, 21600000000


def notes_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of every piece: (piece_id, onset, pitch), from the users' events. Integers, so that differences group exactly."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("piece_id"),
        F.floor((micros - ORIGIN) / STEP).cast("long").alias("onset"),
        (60 + F.floor("value").cast("long") % 24).alias("pitch"),
    ).distinct()


def annotated_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """notes_view with staff, duration (functions of the pitch) and type, the least event type of the note."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("piece_id"),
        F.floor((micros - ORIGIN) / STEP).cast("long").alias("onset"),
        (60 + F.floor("value").cast("long") % 24).alias("pitch"),
        "event_type",
    )
    out = rows.groupBy("piece_id", "onset", "pitch").agg(F.min("event_type").alias("type"))
    return out.withColumn("staff", F.col("pitch") % 2).withColumn("duration", 1 + F.col("pitch") % 4)


NOTES_SQL = """notes AS (
  SELECT DISTINCT user_id AS piece_id, CAST(floor((epoch_us(ts) - 1704067200000000) / 21600000000) AS BIGINT) AS onset,
         60 + CAST(floor(value) AS BIGINT) % 24 AS pitch FROM events)"""
ANNOTATED_SQL = """anno AS (
  SELECT user_id AS piece_id, CAST(floor((epoch_us(ts) - 1704067200000000) / 21600000000) AS BIGINT) AS onset,
         60 + CAST(floor(value) AS BIGINT) % 24 AS pitch, min(event_type) AS type,
         (60 + CAST(floor(value) AS BIGINT) % 24) % 2 AS staff, 1 + (60 + CAST(floor(value) AS BIGINT) % 24) % 4 AS duration
  FROM events GROUP BY 1, 2, 3, 5, 6)"""
