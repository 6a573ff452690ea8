"""Queries of the encoder and of windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import dot, unit
from ..operators import encoder, evaluate, prep, tokens
from ..operators import retrieval as r
from ..session import ANNOTATED_SQL, annotated_notes, notes_view, table
from ..streaming.counts import window_counts
from . import music


def encoded_segments(spark: SparkSession, d: str) -> DataFrame:
    cfg = r.Config()
    out = encoder.segment_vectors(r.steps(r.membership(notes_view(spark, d), cfg)), encoder.random_weights())
    return out.select("piece_id", "seg", F.size("vector").alias("width"), F.round(dot(F.col("vector"), F.col("vector")), 4).alias("length"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    out = window_counts(table(spark, d, "events"))
    return out.select(F.unix_micros("window_start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").where("embedding is not null").withColumn("u", unit(F.col("embedding")))
    return e.select("vec_id", F.round(dot(F.col("u"), F.col("u")), 5).alias("length"), F.round(F.col("u")[0], 5).alias("first"))


def notes_per_beat(spark: SparkSession, d: str) -> DataFrame:
    n = annotated_notes(spark, d)
    notes = n.select("piece_id", (F.col("onset") + F.col("pitch") % 10 / 10).alias("start"), (F.col("onset") + F.col("pitch") % 10 / 10 + F.col("duration") / 8).alias("end"), "pitch")
    beats = n.where("staff = 0").select("piece_id", F.col("onset").alias("beat"), F.col("onset").cast("double").alias("at")).distinct()
    return prep.notes_per_beat(notes, beats, rescue=0.25, least=0.2).select("piece_id", F.round("start", 3).alias("start"), "pitch", "beat")


def beat_ticks(spark: SparkSession, d: str) -> DataFrame:
    notes = annotated_notes(spark, d).select("piece_id", F.col("onset").alias("beat"), "pitch", (F.col("pitch") % 7 / 7).alias("start"), (F.col("pitch") % 7 / 7 + F.col("duration") / 16).alias("end"))
    return prep.beat_ticks(notes).select("piece_id", "beat", "pitch", "start_tick", "end_tick")


def merged_tracks(spark: SparkSession, d: str) -> DataFrame:
    n = annotated_notes(spark, d).select("piece_id", F.col("onset").alias("start"), (F.col("onset") + F.col("duration")).alias("end"), "pitch", "staff")
    a, b = (n.where(F.col("staff") == k).drop("staff") for k in (0, 1))
    return prep.merged_tracks(a, b).select("piece_id", "start", "pitch", F.col("place").cast("long").alias("place"))


def decoded_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens turned back into notes."""
    return tokens.decode(music.bar_tokens(spark, d))


def melody_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """The highest note of each onset as a guess of the labelled ones."""
    n = annotated_notes(spark, d)
    top = n.groupBy("piece_id", "onset").agg(F.max("pitch").alias("pitch"))
    return evaluate.melody_accuracy(n, top, ["piece_id", "onset", "pitch"], F.col("type").isin("click", "view"), F.col("type") == "click")


def price_difference(spark: SparkSession, d: str) -> DataFrame:
    """Whether orders of one status cost more than the others (Welch)."""
    o = table(spark, d, "orders").select(F.col("o_totalprice").cast("double").alias("v"), "o_orderstatus")
    out = evaluate.welch(o, F.col("o_orderstatus") == "F", F.col("v"))
    return out.select(F.round("t", 5).alias("t"), F.round("freedom", 2).alias("freedom"))


QUERIES = {f.__name__: f for f in (encoded_segments, event_windows, unit_vectors, notes_per_beat, beat_ticks, merged_tracks, decoded_tokens, melody_accuracy, price_difference)}
ORACLE = {
    "event_windows": """WITH w AS (SELECT epoch_us(ts) AS t, event_type, value FROM events), k AS (SELECT event_type, value, unnest(generate_series(CAST(floor(t / 21600000000) AS BIGINT) - 3, CAST(floor(t / 21600000000) AS BIGINT))) * 21600000000 AS start FROM w)
SELECT start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM k GROUP BY 1, 2""",
    "unit_vectors": "WITH e AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings WHERE embedding IS NOT NULL) SELECT vec_id, round(CASE WHEN n < 1e-9 THEN 0 ELSE 1 END, 5)::DOUBLE AS length, round(CASE WHEN n < 1e-9 THEN 0 ELSE embedding[1]::DOUBLE / n END, 5) AS first FROM e",
    "notes_per_beat": f"""WITH {ANNOTATED_SQL}, b AS (SELECT piece_id, beat, lead(beat) OVER (PARTITION BY piece_id ORDER BY beat) AS nx FROM (SELECT DISTINCT piece_id, onset AS beat FROM anno WHERE staff = 0)),
n AS (SELECT piece_id, onset + pitch % 10 / 10 AS s, onset + pitch % 10 / 10 + duration / 8 AS e, pitch FROM anno)
SELECT n.piece_id, round(n.s, 3) AS start, n.pitch, CASE WHEN nx - s <= 0.25 AND e - s > 0.2 THEN nx ELSE beat END AS beat FROM n ASOF JOIN b ON n.piece_id = b.piece_id AND n.s >= b.beat WHERE nx IS NOT NULL""",
    "beat_ticks": f"""WITH {ANNOTATED_SQL}, t AS (SELECT piece_id, onset AS beat, pitch, CAST(onset * 480 + round_even(pitch % 7 / 7 * 480 / 120, 0) * 120 AS BIGINT) AS start_tick, CAST(onset * 480 + round_even((pitch % 7 / 7 + duration / 16) * 480 / 120, 0) * 120 AS BIGINT) AS end_tick FROM anno)
SELECT * FROM t WHERE end_tick > start_tick""",
    "merged_tracks": f"WITH {ANNOTATED_SQL} SELECT piece_id, onset AS start, pitch, row_number() OVER (PARTITION BY piece_id ORDER BY onset, pitch DESC, onset + duration) AS place FROM anno",
    "decoded_tokens": f"WITH {music.WORDS} SELECT piece_id, w, (dense_rank() OVER (PARTITION BY piece_id ORDER BY bar) - 1) * 16 + CAST(greatest(0, least(15, ceil((onset - s) / (e - s) * 16 - 0.5))) AS BIGINT) AS onset, greatest(0, least(85, pitch - 22)) + 22 AS pitch, CAST(greatest(0, least(63, ceil((duration - 60) / 60 - 0.5))) AS BIGINT) + 1 AS duration FROM w",
    "melody_accuracy": f"""WITH {ANNOTATED_SQL}, t AS (SELECT *, pitch = max(pitch) OVER (PARTITION BY piece_id, onset) AS f, type IN ('click', 'view') AS w, type = 'click' AS n FROM anno)
SELECT """ + ", ".join(f"CAST(sum(CASE WHEN {'' if gold else 'NOT '}{g} AND {'' if found else 'NOT '}f THEN 1 ELSE 0 END) AS BIGINT) AS {name}_{label}" for name, g in (("wide", "w"), ("narrow", "n")) for label, gold, found in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))) + " FROM t",
    "price_difference": """WITH s AS (SELECT avg(v) FILTER (f) AS m1, avg(v) FILTER (NOT f) AS m0, var_samp(v) FILTER (f) AS v1, var_samp(v) FILTER (NOT f) AS v0, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n0 FROM (SELECT CAST(o_totalprice AS DOUBLE) AS v, o_orderstatus = 'F' AS f FROM orders))
SELECT round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 5) AS t, round(pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)), 2) AS freedom FROM s""",
}
