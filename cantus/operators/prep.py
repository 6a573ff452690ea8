"""Preparation of notes: as-of joins, tempo maps, quantisation, melody skyline, piano rolls, beats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: str, time: str, at: str, values: list[str], strict: bool = False) -> DataFrame:
    """left with `values` of the latest row of right whose `at` is at most left's `time` (strict: before it), within `by`.
    Null where there is none. One sort of both sides; of right rows at the same time the last by value counts."""
    r = right.select(F.col(by), F.col(at).alias(time), F.struct(*values).alias("_v"), F.lit(1 if strict else 0).alias("_s"))
    both = left.withColumn("_s", F.lit(0 if strict else 1)).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(time, "_s", "_v").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_c", F.last("_v", ignorenulls=True).over(w)).where(F.col("_s") == (0 if strict else 1))
    return out.select(*left.columns, *(F.col(f"_c.{v}").alias(v) for v in values))


def tempo_seconds(changes: DataFrame) -> DataFrame:
    """(piece_id, tick, bpm) to (piece_id, tick, bpm, seconds): the time at which each tempo begins, at 480 ticks per beat."""
    w = Window.partitionBy("piece_id").orderBy("tick")
    step = (F.col("tick") - F.lag("tick").over(w)) / 480 * 60 / F.lag("bpm").over(w)
    out = changes.withColumn("step", F.coalesce(step, F.lit(0.0)))
    return out.select("piece_id", "tick", "bpm", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("seconds"))


def note_seconds(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """notes (piece_id, tick) with seconds over the tempo map; a change counts for ticks after it."""
    found = as_of(notes, tempo_seconds(changes).withColumnRenamed("tick", "t0"), "piece_id", "tick", "t0", ["t0", "bpm", "seconds"], strict=True)
    return found.select(*notes.columns, (F.coalesce("seconds", F.lit(0.0)) + (F.col("tick") - F.coalesce("t0", F.lit(0))) / 480 * 60 / F.coalesce("bpm", F.lit(120))).alias("seconds"))


def note_beats(notes: DataFrame, beats: DataFrame) -> DataFrame:
    """notes (piece_id, time) with beat, interpolated between beat times (piece_id, beat, at) and drawn on beyond both ends."""
    w = Window.partitionBy("piece_id").orderBy("at")
    steps = beats.select("piece_id", "at", "beat", F.lead("at").over(w).alias("next"), F.lag("at").over(w).alias("prev"))
    steps = steps.withColumn("length", F.coalesce(F.col("next") - F.col("at"), F.col("at") - F.col("prev")))
    first = steps.groupBy("piece_id").agg(F.min(F.struct("at", "beat", "length")).alias("f"))
    out = as_of(notes, steps, "piece_id", "time", "at", ["at", "beat", "length"]).join(first, "piece_id", "left")
    pick = lambda c: F.coalesce(F.col(c), F.col(f"f.{c}"))
    return out.select(*notes.columns, (pick("beat") + (F.col("time") - pick("at")) / pick("length")).alias("beat"))


def skyline(notes: DataFrame, grid: int = 240, lowest: int = 60, drop: int = 9, drop_last_group: bool = True) -> DataFrame:
    """The melody of notes (piece_id, start, end, pitch): long notes are cut, times rounded to the grid (half to even), the
    highest note from `lowest` up stays at each start, ends yield to the next start, empty notes go, and so do notes that lie
    `drop` semitones or more below both neighbours. With drop_last_group the last start is left out."""
    q = notes.withColumn("end", F.when(F.col("end") - F.col("start") > 8 * grid, F.col("start") + 4 * grid).otherwise(F.col("end")))
    q = q.select("piece_id", *((F.bround(F.col(c) / grid, 0) * grid).cast("long").alias(c) for c in ("start", "end")), "pitch").where(F.col("pitch") >= lowest)
    top = q.groupBy("piece_id", "start").agg(F.max(F.struct("pitch", (-F.col("end")).alias("e"))).alias("t")).select("piece_id", "start", (-F.col("t.e")).alias("end"), "t.pitch")
    w = Window.partitionBy("piece_id").orderBy("start")
    top = top.withColumn("next", F.lead("start").over(w))
    top = top.where("next is not null").withColumn("last", F.lead("start").over(w)) if drop_last_group else top.withColumn("last", F.col("next"))
    cut = top.withColumn("end", F.when(F.col("end") >= F.col("last"), F.col("last")).otherwise(F.col("end"))).where("start <> end")
    below = (F.col("pitch") - F.lag("pitch").over(w) <= -drop) & (F.col("pitch") - F.lead("pitch").over(w) <= -drop)
    return cut.withColumn("below", F.coalesce(below, F.lit(False))).where("not below").select("piece_id", "start", "end", "pitch")


def piano_roll(notes: DataFrame) -> DataFrame:
    """(piece_id, slot, pitch): every slot that a note sounds in, once."""
    return notes.where("duration > 0").select("piece_id", F.explode(F.sequence("onset", F.col("onset") + F.col("duration") - 1)).alias("slot"), "pitch").distinct()


def grid_ticks(start: Column, end: Column, grid: int = 120) -> tuple[Column, Column]:
    """A span moved so that it starts on the nearest grid point (ties low)."""
    to = F.ceil(start / grid - 0.5) * grid
    return to, end + to - start


def tempo_changes(beats: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(piece_id, beat, length) to the beats whose length differs from the last kept one's by over the tolerance: a fold over a piece's beats in order."""
    rows = beats.groupBy("piece_id").agg(F.sort_array(F.collect_list(F.struct("beat", "length"))).alias("b"))
    start = F.array().cast("array<struct<beat:bigint,length:double>>")

    def keep(acc: Column, x: Column) -> Column:
        return F.when((F.size(acc) == 0) | (F.abs(F.element_at(acc, -1)["length"] - x["length"]) > tolerance), F.concat(acc, F.array(x))).otherwise(acc)

    out = rows.select("piece_id", F.explode(F.aggregate("b", start, lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).otherwise(keep(acc, x)))).alias("k"))
    return out.select("piece_id", "k.beat", "k.length")


def without_collisions(beats: DataFrame, voice: DataFrame, before: int = 1, after: int = 2) -> DataFrame:
    """beats (piece_id, beat) around which, from `before` earlier to `after` later, no voice has a note: an anti-join on exploded neighbours."""
    near = voice.select("piece_id", F.explode(F.sequence(F.col("beat") - after, F.col("beat") + before)).alias("beat")).distinct()
    return beats.join(near, ["piece_id", "beat"], "left_anti")


def notes_per_beat(notes: DataFrame, beats: DataFrame, rescue: float = 0.1, least: float = 0.2) -> DataFrame:
    """notes (piece_id, start, end, pitch) with the beat (piece_id, beat, at) they begin in. A note that begins within `rescue` before the
    next beat and is longer than `least` belongs to that beat; notes before the first beat and after the last beat's start go."""
    w = Window.partitionBy("piece_id").orderBy("at")
    steps = beats.select("piece_id", "at", "beat", F.lead("at").over(w).alias("next"), F.lead("beat").over(w).alias("next_beat"))
    found = as_of(notes.withColumnRenamed("start", "time"), steps, "piece_id", "time", "at", ["at", "beat", "next", "next_beat"]).where("next is not null")
    late = (F.col("next") - F.col("time") <= rescue) & (F.col("end") - F.col("time") > least)
    return found.select("piece_id", F.col("time").alias("start"), "end", "pitch", F.when(late, F.col("next_beat")).otherwise(F.col("beat")).alias("beat"))


def beat_ticks(notes: DataFrame, per_beat: int = 480, grid: int = 120) -> DataFrame:
    """notes (piece_id, beat, start, end in beats from it) with start_tick and end_tick on the grid (half to even); empty ones go."""
    tick = lambda c: (F.col("beat") * per_beat + F.bround(F.col(c) * per_beat / grid, 0) * grid).cast("long")
    return notes.withColumn("start_tick", tick("start")).withColumn("end_tick", tick("end")).where("end_tick > start_tick")


def merged_tracks(*tracks: DataFrame) -> DataFrame:
    """Notes of all tracks in order of time, higher ones first: place is their number in the piece."""
    out = tracks[0]
    for t in tracks[1:]:
        out = out.unionByName(t)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("piece_id").orderBy("start", F.desc("pitch"), "end")))


def qualified_beats(beats: DataFrame, tolerance: float = 0.03) -> DataFrame:
    """(piece_id, place, major, minor) of beats, with their place in the bar by ear and flags of the score's beats, to
    (piece_id, meter, share, qualified): pieces in four whose share of major flags is near a quarter, or in three whose share of minor ones is near a third."""
    s = beats.groupBy("piece_id").agg(F.max("place").alias("meter"), F.avg(F.col("major").cast("double")).alias("major"), F.avg(F.col("minor").cast("double")).alias("minor"))
    share = F.when(F.col("meter") == 4, F.col("major")).when(F.col("meter") == 3, F.col("minor"))
    want = F.when(F.col("meter") == 4, F.lit(0.25)).otherwise(F.lit(0.33))
    return s.select("piece_id", "meter", share.alias("share"), F.coalesce(F.abs(want - share) < tolerance, F.lit(False)).alias("qualified"))
