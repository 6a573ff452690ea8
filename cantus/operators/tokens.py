"""Tokens of notes in bars: bar, position, pitch, duration; chunks, ensembles of scores, folds, relabelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import nearest

#: Sizes of the vocabularies with padding and mask last (fixed values), and where pitches begin.
BAR, POSITION, PITCH, DURATION, LOWEST = 4, 18, 88, 66, 22
LENGTH = 512


def bars(downbeats: DataFrame) -> DataFrame:
    """(piece_id, downbeat) to (piece_id, bar, start, end): one bar before the first and one after the last are added, as long as their neighbours."""
    w = Window.partitionBy("piece_id")
    d = downbeats.select("piece_id", "downbeat")
    ends = d.withColumn("r", F.row_number().over(w.orderBy("downbeat"))).withColumn("q", F.row_number().over(w.orderBy(F.desc("downbeat"))))
    e = ends.groupBy("piece_id").agg(*(F.max(F.when(F.col(c) == k, F.col("downbeat"))).alias(f"{c}{k}") for c in "rq" for k in (1, 2)))
    first = e.where("r1 > 0").select("piece_id", (2 * F.col("r1") - F.col("r2")).alias("downbeat")).where("downbeat is not null")
    last = e.select("piece_id", (2 * F.col("q1") - F.col("q2")).alias("downbeat")).where("downbeat is not null")
    out = d.unionByName(first).unionByName(last).select("piece_id", F.col("downbeat").alias("start"), F.lead("downbeat").over(w.orderBy("downbeat")).alias("end"))
    return out.where("end is not null").withColumn("bar", F.row_number().over(w.orderBy("start")))


def in_bars(notes: DataFrame, bar: DataFrame) -> DataFrame:
    """notes with bar, start and end of the bar they begin in. Both sides are merged in order of time and the last bar's start is carried to
    the notes after it (an as-of join: no comparison of every note with every bar)."""
    b = bar.select("piece_id", F.col("start").alias("onset"), F.lit(0).alias("side"), F.struct("bar", "start", "end").alias("b"))
    n = notes.withColumn("side", F.lit(1))
    both = n.unionByName(b, allowMissingColumns=True)
    carried = F.last("b", ignorenulls=True).over(Window.partitionBy("piece_id").orderBy("onset", "side").rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("b", carried).where("side = 1").drop("side")
    return out.where(F.col("onset") < F.col("b.end")).select(*notes.columns, "b.bar", "b.start", "b.end")


def events(notes: DataFrame, duration_step: int = 60, fractions: int = 16) -> DataFrame:
    """Words of notes (piece_id, onset, pitch, duration, bar, start, end): w, their order in the piece, is_new (first of its
    bar), position (nearest of 16ths of the bar) and duration_bin (nearest multiple of duration_step, up to 64); ties go low."""
    w = Window.partitionBy("piece_id").orderBy("onset", "pitch")
    first = F.row_number().over(Window.partitionBy("piece_id", "bar").orderBy("onset", "pitch")) == 1
    at = (F.col("onset") - F.col("start")) / (F.col("end") - F.col("start")) * fractions
    return notes.select("*", (F.row_number().over(w) - 1).alias("w"), first.alias("is_new"), nearest(at, 1, fractions, 0).alias("position"), nearest(F.col("duration"), duration_step, 64).alias("duration_bin"))


def encode(words: DataFrame) -> DataFrame:
    """Token ids: bar (0 new, 1 continue), position, pitch from 22, duration."""
    return words.select("*", F.when(F.col("is_new"), 0).otherwise(1).alias("t_bar"), F.col("position").alias("t_position"), F.greatest(F.lit(0), F.least(F.lit(PITCH - 3), F.col("pitch") - LOWEST)).cast("int").alias("t_pitch"), F.col("duration_bin").alias("t_duration"))


def chunks(words: DataFrame, offset: int = 0, length: int = LENGTH) -> DataFrame:
    """Words with chunk and pos, in chunks of `length` places, the first `offset` of which are padding."""
    return words.select("*", F.floor((F.col("w") + offset) / length).alias("chunk"), F.pmod(F.col("w") + offset, F.lit(length)).alias("pos"))


def padding(chunked: DataFrame, length: int = LENGTH) -> DataFrame:
    """(piece_id, chunk, n_words, n_padding)."""
    return chunked.groupBy("piece_id", "chunk").agg(F.count(F.lit(1)).alias("n_words")).withColumn("n_padding", F.lit(length) - F.col("n_words"))


def ensemble(scores: DataFrame, classes: int, positive: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Scores (piece_id, w, run, chunk, s0 .. s<classes-1>) of several runs to one prediction per word: positive scores of a chunk are
    raised so that at least one word in it is positive, runs are added, and the largest wins (ties to the lower class)."""
    names = [f"s{k}" for k in range(classes)]
    best_other = F.greatest(*(F.col(n) for k, n in enumerate(names) if k not in positive))
    best_own = F.greatest(*(F.col(f"s{k}") for k in positive))
    lift = F.least(F.max(best_own - best_other).over(Window.partitionBy("piece_id", "run", "chunk")), F.lit(0.0))
    lifted = scores.withColumn("lift", lift).select("piece_id", "w", *((F.col(n) - F.col("lift") if k in positive else F.col(n)).alias(n) for k, n in enumerate(names)))
    total = lifted.groupBy("piece_id", "w").agg(*(F.sum(n).alias(n) for n in names))
    values = F.array(*(F.round(n, 6) for n in names))
    return total.select("piece_id", "w", (F.array_position(values, F.array_max(values)) - 1).cast("int").alias("predicted"))


def folds(pieces: DataFrame, number: Column, sizes: tuple[int, ...] = (7, 7, 6, 6, 6)) -> DataFrame:
    """pieces with fold, by a piece's number (from 0) in runs of the given sizes, again and again; fold k tests on k, validates on k + 1, trains on the rest."""
    at = F.pmod(number, F.lit(sum(sizes)))
    fold, edge = F.lit(len(sizes) - 1), sum(sizes)
    for k in range(len(sizes) - 1, 0, -1):
        edge -= sizes[k]
        fold = F.when(at < edge, k - 1).otherwise(fold)
    return pieces.withColumn("fold", fold)


def relabel(type_: Column, predicted: Column, mode: str) -> Column:
    """A note's label after pseudo-labelling: `predicted` marks what is predicted, `intersection` keeps the label only where it is."""
    return F.when(predicted, F.lit("a")).otherwise("") if mode == "predicted" else F.when(predicted, type_).otherwise("")


def shifted(notes: DataFrame, semitones: int) -> DataFrame:
    """Notes without a label moved by semitones, within 24 to 107."""
    return notes.withColumn("pitch", F.when(F.col("type") == "", F.greatest(F.lit(24), F.least(F.lit(107), F.col("pitch") + semitones))).otherwise(F.col("pitch")))


def class_means(notes: DataFrame) -> DataFrame:
    """Number and mean pitch of labelled and unlabelled notes."""
    return notes.groupBy((F.col("type") != "").alias("labelled")).agg(F.count(F.lit(1)).alias("n"), F.avg("pitch").alias("mean_pitch"))


def decode(words: DataFrame, bar_length: int = 16) -> DataFrame:
    """Token ids (piece_id, w, t_bar, t_position, t_pitch, t_duration) back to notes: (piece_id, w, onset in 16ths, pitch, duration in steps of the duration bins). A bar token 0 begins a bar."""
    w = Window.partitionBy("piece_id").orderBy("w").rowsBetween(Window.unboundedPreceding, 0)
    bar = F.sum(F.when(F.col("t_bar") == 0, 1).otherwise(0)).over(w) - 1
    return words.select("piece_id", "w", (bar * bar_length + F.col("t_position")).alias("onset"), (F.col("t_pitch") + LOWEST).alias("pitch"), (F.col("t_duration") + 1).alias("duration"))


def aligned_labels(chunked: DataFrame, length: int = LENGTH) -> DataFrame:
    """Every place of every chunk with its note's label: (piece_id, chunk, pos, label), 1 for a note with a type, 3 for one without, 0 for padding."""
    places = chunked.select("piece_id", "chunk").distinct().withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    label = chunked.select("piece_id", "chunk", F.col("pos").cast("int").alias("pos"), F.when(F.col("type") != "", 1).otherwise(3).alias("label"))
    return places.join(label, ["piece_id", "chunk", "pos"], "left").select("piece_id", "chunk", "pos", F.coalesce("label", F.lit(0)).alias("label"))


def variants(notes: DataFrame, semitones: tuple[int, ...] = (-5, -4, -3, -2, -1, 0, 1, 2, 3, 4, 5, 6), offsets: tuple[int, ...] = (0, 256), keep: int | None = None, seed: int = 1) -> DataFrame:
    """notes once for every shift of pitches and offset of chunks, as (variant, semitones, offset, ...); with keep, of that many
    variants per piece, drawn by a hash. Only notes without a type are shifted, within 24 to 107."""
    each = F.array(*(F.struct(F.lit(k).alias("variant"), F.lit(s).alias("semitones"), F.lit(o).alias("offset")) for k, (s, o) in enumerate((s, o) for s in semitones for o in offsets)))
    if keep is not None:
        drawn = F.sort_array(F.transform(each, lambda v: F.struct(F.xxhash64("piece_id", v["variant"], F.lit(seed)).alias("h"), v.alias("v"))))
        each = F.transform(F.slice(drawn, 1, keep), lambda x: x["v"])
    out = notes.withColumn("v", F.explode(each)).select("v.*", *notes.columns)
    moved = F.greatest(F.lit(24), F.least(F.lit(107), F.col("pitch") + F.col("semitones")))
    return out.withColumn("pitch", F.when(F.col("type") == "", moved).otherwise(F.col("pitch")))
