"""Cumulative-snapshot collapse of logged conversations, in DataFrame functions alone.

Chat logs hold a conversation once for every turn it had when it was logged. Every turn gets a rolling hash of the
conversation up to it; a conversation whose whole hash is the hash of a proper prefix of another is dropped by an
anti-join, and the maximal ones are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import Store

#: Bits of the parts that a turn's hash is summed in; sums of up to 2**31 turns fit in a long.
PART = 32


def placed(store: Store, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places, texts) of the distinct turns of (conv_id, turn, role, text). places: (conv_id, turn, digest, range, pos, n),
    with pos the turn's place in its conversation of n turns; texts: (conv_id, turn, digest, role, text).

    Long conversations may be spread over many tasks: turns are dealt by ranges of (conv_id, turn), counted and summed
    within each range, and the ranges' totals are added in a second, small pass. Joins are by (conv_id, range), so that
    none gathers a conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = turns.select("conv_id", "turn", role.alias("role"), text.alias("text")).where("conv_id is not null")
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    texts = store.save(turns.withColumn("digest", digest).groupBy("conv_id", "turn", "digest").agg(F.first("role").alias("role"), F.first("text").alias("text")))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    light = texts.select("conv_id", "turn", "digest").repartitionByRange(parts, "conv_id", "turn", "digest").withColumn("range", F.spark_partition_id())
    within = Window.partitionBy("range", "conv_id").orderBy("turn", "digest")
    # Written once: what reads it below must see the same ranges, which another shuffle could draw elsewhere.
    light = store.save(light.withColumn("rank", F.row_number().over(within)))
    counts = light.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("conv_id", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"), F.sum("n").over(Window.partitionBy("conv_id")).alias("n"))
    places = light.join(counts, ["conv_id", "range"]).select("conv_id", "turn", "digest", "range", (F.col("skip") + F.col("rank")).alias("pos"), "n")
    return store.save(places), texts


def maximal(turns: DataFrame) -> DataFrame:
    """The turns (conv_id, n, pos, role, text) of conversations that no longer one begins with; of equal ones the smallest conv_id stays."""
    store = Store(turns.sparkSession)
    places, texts = placed(store, turns)
    light = places
    for k, seed in enumerate(("a", "b")):
        h = F.xxhash64("pos", "digest", F.lit(seed))
        light = light.withColumn(f"x{2 * k}", h.bitwiseAND(0xFFFFFFFF)).withColumn(f"x{2 * k + 1}", F.shiftrightunsigned(h, PART))
    within = Window.partitionBy("range", "conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"x{k}" for k in range(4)]
    sums = light.groupBy("conv_id", "range").agg(*(F.sum(x).alias(x) for x in names))
    sums = sums.select("conv_id", "range", *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"s{x}") for x in names))
    rolling = light.select("conv_id", "range", "pos", "n", *(F.sum(x).over(within).alias(x) for x in names)).join(sums, ["conv_id", "range"])
    rolling = store.save(rolling.select("conv_id", "pos", "n", *((F.col(x) + F.col(f"s{x}")).alias(x) for x in names)))
    whole = rolling.where("pos = n").groupBy("n", *names).agg(F.min("conv_id").alias("conv_id"))
    proper = rolling.where("pos < n").select(F.col("pos").alias("n"), *names).distinct()
    kept = whole.join(proper, ["n", *names], "left_anti").select("conv_id")
    kept = places.select("conv_id", "range").distinct().join(kept, "conv_id")
    at = (F.coalesce("turn", F.lit(-1)), F.col("turn").isNull())
    texts = texts.select("conv_id", at[0].alias("turn"), at[1].alias("no_turn"), "digest", "role", "text")
    place = places.join(kept, ["conv_id", "range"]).select("conv_id", "n", at[0].alias("turn"), at[1].alias("no_turn"), "digest", "pos")
    return place.join(texts, ["conv_id", "turn", "no_turn", "digest"]).select("conv_id", "n", "pos", "role", "text")


def collapse(conversations: DataFrame, begin: str = "<|im_start|>", end: str = "<|im_end|>", id_col: str = "conv_id") -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns and rendered, its turns in order as `begin`role, newline, text `end`, newline.

    Turns are ordered by `turn` (null first, ties by a digest of the role's length, role and text). Rows that repeat a turn with the same
    role and text count once. Null roles and texts are empty. Rows with a null conv_id belong to no conversation. Of
    equal conversations the one with the smallest conv_id stays. Other columns are ignored; an empty table gives an empty result.
    """
    turns = maximal(conversations.select(F.col(id_col).alias("conv_id"), "turn", "role", "text"))
    message = F.concat(F.lit(begin), "role", F.lit("\n"), "text", F.lit(end + "\n"))
    rows = turns.groupBy("conv_id", "n").agg(F.sort_array(F.collect_list(F.struct("pos", message.alias("m")))).alias("list"))
    return rows.select("conv_id", F.col("n").cast("long").alias("n_turns"), F.concat_ws("", F.col("list.m")).alias("rendered"))
