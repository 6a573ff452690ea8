"""Audit of predicted motifs and statistics of windows and similarities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import jaccard, scale_of, time_iou

PERCENTS = (10, 25, 50, 75, 90, 95, 99)


def percentiles(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """min, p10 .. p99 (interpolated), max and mean of a column, for each group."""
    exprs = [F.min(value).alias("min"), *(F.percentile(value, F.lit(p / 100)).alias(f"p{p}") for p in PERCENTS), F.max(value).alias("max"), F.avg(value).alias("mean")]
    return (rows.groupBy(*by) if by else rows).agg(*exprs)


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of equal bins between low and high; what lies outside goes to the first or last."""
    b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(value) - low) / ((high - low) / bins)))).cast("long")
    return rows.where(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def occurrence_spans(motifs: DataFrame) -> DataFrame:
    """Rows (piece_id, motif, occ, onset, pitch) to one per occurrence: n_notes, start, end, span."""
    return motifs.groupBy("piece_id", "motif", "occ").agg(F.count(F.lit(1)).alias("n_notes"), F.min("onset").alias("start"), F.max("onset").alias("end")).withColumn("span", F.col("end") - F.col("start"))


def overlaps(motifs: DataFrame, within: bool) -> DataFrame:
    """(piece_id, ma, oa, mb, ob, jaccard, iou) of pairs of occurrences that share a note: of one motif (within), or of two motifs ma < mb."""
    a = motifs.select("piece_id", F.col("motif").alias("ma"), F.col("occ").alias("oa"), "onset", "pitch")
    b = motifs.select("piece_id", F.col("motif").alias("mb"), F.col("occ").alias("ob"), "onset", "pitch")
    keep = "ma = mb and oa < ob" if within else "ma < mb"
    both = a.join(b, ["piece_id", "onset", "pitch"]).where(keep).groupBy("piece_id", "ma", "oa", "mb", "ob").agg(F.count(F.lit(1)).alias("both"))
    s = occurrence_spans(motifs)
    for x in "ab":
        both = both.join(s.select("piece_id", F.col("motif").alias(f"m{x}"), F.col("occ").alias(f"o{x}"), F.col("n_notes").alias(f"n{x}"), F.col("start").alias(f"{x}0"), F.col("end").alias(f"{x}1")), ["piece_id", f"m{x}", f"o{x}"])
    return both.select("piece_id", "ma", "oa", "mb", "ob", jaccard(F.col("both"), F.col("na"), F.col("nb")).alias("jaccard"), time_iou(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1")).alias("iou"))


def touching(motifs: DataFrame, width: int = 64) -> DataFrame:
    """(piece_id, ma, mb, iou) of pairs of occurrences of two motifs ma < mb whose spans overlap in time. Both sides meet in
    the stretch of `width` steps in which the later one begins."""
    s = occurrence_spans(motifs).withColumn("stretch", F.explode(F.sequence(*(F.floor(F.col(c) / width).cast("long") for c in ("start", "end")))))
    a, b = (s.select("piece_id", "stretch", *(F.col(c).alias(f"{x}_{c}") for c in ("motif", "start", "end"))) for x in "ab")
    both = a.join(b, ["piece_id", "stretch"]).where("a_motif < b_motif and greatest(a_start, b_start) < least(a_end, b_end)")
    both = both.where(F.floor(F.greatest("a_start", "b_start") / width) == F.col("stretch"))
    return both.select("piece_id", F.col("a_motif").alias("ma"), F.col("b_motif").alias("mb"), time_iou(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end")).alias("iou"))


def best_overlap(motifs: DataFrame) -> DataFrame:
    """For each pair of motifs of a piece the pair of occurrences with most overlap in notes, ties by overlap in time: (piece_id, ma, mb, jaccard, iou).
    Motifs without a common note have their best overlap in time; pairs with neither are left out (both are 0)."""
    key = ["piece_id", "ma", "mb"]
    notes = overlaps(motifs, within=False).groupBy(*key).agg(F.max(F.struct("jaccard", "iou")).alias("b"))
    time = touching(motifs).groupBy(*key).agg(F.max("iou").alias("t"))
    out = notes.join(time, key, "full")
    return out.select(*key, F.coalesce("b.jaccard", F.lit(0.0)).alias("jaccard"), F.when(F.col("b").isNotNull(), F.col("b.iou")).otherwise(F.col("t")).alias("iou"))


def motif_spread(motifs: DataFrame) -> DataFrame:
    """(piece_id, motif, n_occurrences, and min, mean and max of spans and notes, ratio): ratio is the longest span over the mean number of notes."""
    s = occurrence_spans(motifs)
    each = [f(c).alias(f"{n}_{c}") for c in ("span", "n_notes") for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max))]
    return s.groupBy("piece_id", "motif").agg(F.count(F.lit(1)).alias("n_occurrences"), *each).withColumn("ratio", F.col("max_span") / F.greatest("mean_n_notes", F.lit(1e-6)))


def piece_summary(motifs: DataFrame, near: float = 0.8, subset: float = 0.9, sparse: float = 4.0) -> DataFrame:
    """One row per piece: numbers of motifs and occurrences; least, mean and largest span and number of notes (means are those of the
    motifs' means); motifs whose longest span is at least `sparse` times their mean number of notes; the mean best overlap of all
    pairs of motifs in notes and in time, and how many pairs reach `near` (near duplicates) and `subset` in either."""
    base = motif_spread(motifs).groupBy("piece_id").agg(
        F.count(F.lit(1)).alias("n_motifs"), F.sum("n_occurrences").alias("n_occurrences"), F.min("min_span").alias("min_span"), F.avg("mean_span").alias("mean_span"), F.max("max_span").alias("max_span"),
        F.min("min_n_notes").alias("min_notes"), F.avg("mean_n_notes").alias("mean_notes"), F.max("max_n_notes").alias("max_notes"), F.sum(F.when(F.col("ratio") >= sparse, 1).otherwise(0)).alias("n_sparse"),
    )
    either = lambda t: F.sum(F.when((F.col("jaccard") >= t) | (F.col("iou") >= t), 1).otherwise(0))
    pairs = best_overlap(motifs).groupBy("piece_id").agg(F.sum("jaccard").alias("sum_jaccard"), F.sum("iou").alias("sum_iou"), either(near).alias("near_duplicates"), either(subset).alias("subset_pairs"))
    out = base.join(pairs, "piece_id", "left").fillna(0, ["near_duplicates", "subset_pairs"])
    n = F.col("n_motifs") * (F.col("n_motifs") - 1) / 2
    mean = lambda c: F.when(n > 0, F.coalesce(c, F.lit(0.0)) / n).otherwise(F.lit(0.0))
    return out.withColumn("mean_jaccard", mean("sum_jaccard")).withColumn("mean_iou", mean("sum_iou")).drop("sum_jaccard", "sum_iou")


def within_motif(motifs: DataFrame, most: int = 50) -> DataFrame:
    """Mean and largest overlap, in notes and in time, between occurrences of one motif, over all pairs of its `most` largest ones (the report's own
    limit): pairs that share no note count as 0 notes in common, and with their overlap in time."""
    rank = F.row_number().over(Window.partitionBy("piece_id", "motif").orderBy(F.desc("n_notes"), "occ"))
    s = occurrence_spans(motifs).withColumn("k", rank).where(F.col("k") <= most)
    kept = motifs.join(s.select("piece_id", "motif", "occ"), ["piece_id", "motif", "occ"])
    a, b = (s.select("piece_id", "motif", *(F.col(c).alias(f"{x}_{c}") for c in ("occ", "start", "end"))) for x in "ab")
    iou = time_iou(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))
    n = a.join(b, ["piece_id", "motif"]).where("a_occ < b_occ").groupBy("piece_id", "motif").agg(F.count(F.lit(1)).alias("pairs"), F.avg(iou).alias("mean_iou"), F.max(iou).alias("max_iou"))
    o = overlaps(kept, within=True).groupBy("piece_id", F.col("ma").alias("motif")).agg(F.sum("jaccard").alias("sum_j"), F.max("jaccard").alias("max_j"))
    out = n.join(o, ["piece_id", "motif"], "left")
    return out.select("piece_id", "motif", (F.coalesce("sum_j", F.lit(0.0)) / F.col("pairs")).alias("mean_jaccard"), F.coalesce("max_j", F.lit(0.0)).alias("max_jaccard"), "mean_iou", "max_iou")


def coverage(motifs: DataFrame, notes: DataFrame) -> DataFrame:
    """Per piece: share of notes that some occurrence has, and how often such a note is in one on average."""
    m = motifs.groupBy("piece_id", "onset", "pitch").agg(F.count(F.lit(1)).alias("times"))
    out = notes.join(m, ["piece_id", "onset", "pitch"], "left").groupBy("piece_id").agg(F.avg(F.when(F.col("times").isNotNull(), 1.0).otherwise(0.0)).alias("coverage"), F.coalesce(F.avg("times"), F.lit(0.0)).alias("multiplicity"))
    return out


def span_bins(motifs: DataFrame, scales: Sequence[float]) -> DataFrame:
    """(scale, n_occurrences, n_motifs): occurrences by the smallest scale that covers them, motifs by their median span."""
    s = occurrence_spans(motifs)
    a = s.groupBy(scale_of(F.col("span"), scales).alias("scale")).agg(F.count(F.lit(1)).alias("n_occurrences"))
    m = s.groupBy("piece_id", "motif").agg(F.percentile("span", F.lit(0.5)).alias("median")).groupBy(scale_of(F.col("median"), scales).alias("scale")).agg(F.count(F.lit(1)).alias("n_motifs"))
    return a.join(m, "scale", "full").fillna(0)


def representative(motifs: DataFrame) -> DataFrame:
    """The occurrence with most notes of each motif, ties to the shorter, then the first."""
    s = occurrence_spans(motifs)
    best = s.groupBy("piece_id", "motif").agg(F.max(F.struct("n_notes", (-F.col("span")).alias("m"), (-F.col("occ")).alias("o"))).alias("b"))
    return best.select("piece_id", "motif", (-F.col("b.o")).alias("occ"), "b.n_notes", (-F.col("b.m")).alias("span"))


def best_piece(scores: DataFrame, value: str = "f1") -> DataFrame:
    """The row of the piece with the highest score, ties to the smallest id."""
    return scores.orderBy(F.desc(value), "piece_id").limit(1)


def top_duplicates(motifs: DataFrame, k: int = 10) -> DataFrame:
    """The k pairs of motifs with most overlap of all pieces, in notes, then in time: (place, piece_id, ma, mb, jaccard, iou)."""
    top = best_overlap(motifs).orderBy(F.desc("jaccard"), F.desc("iou"), "piece_id", "ma", "mb").limit(k)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("jaccard"), F.desc("iou"), "piece_id", "ma", "mb")))


def top_sparse(motifs: DataFrame, k: int = 10, sparse: float = 4.0) -> DataFrame:
    """The k motifs with the longest span over their mean number of notes, of those with at least `sparse`: (place, piece_id, motif, ratio)."""
    s = motif_spread(motifs).where(F.col("ratio") >= sparse).select("piece_id", "motif", "ratio")
    order = (F.desc("ratio"), "piece_id", "motif")
    return s.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def top_explosions(motifs: DataFrame, k: int = 8) -> DataFrame:
    """The k pieces with most motifs, ties to the largest id: (place, piece_id, n_motifs)."""
    n = motifs.groupBy("piece_id").agg(F.count_distinct("motif").alias("n_motifs"))
    order = (F.desc("n_motifs"), F.desc("piece_id"))
    return n.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def views(motifs: DataFrame, cases: DataFrame, pad: float = 4.0, context: float = 16.0, rounds: int = 3) -> DataFrame:
    """(case, piece_id, start, end): what to look at of each case (case, piece_id, ma, mb; mb null for a motif alone).

    A view begins as the hull of the two motifs' occurrences that overlap most (of a motif alone: of its representative), `pad` wider on both
    sides. With a context, the spans of the case's motifs within that distance are taken in, pad included, for at most `rounds` rounds: within
    a round motifs and their spans are looked at in order (of occ), each at the view as the one before left it.

    Only the spans of a case meet, in order, in a fold; cases are few (a report's), their spans those of two motifs.
    """
    s = occurrence_spans(motifs).select("piece_id", "motif", "occ", "start", "end")
    two = cases.where("mb is not null")
    hit = overlaps(motifs.join(two.select("piece_id", F.explode(F.array("ma", "mb")).alias("motif")).distinct(), ["piece_id", "motif"], "left_semi"), within=False)
    first = hit.join(two, ["piece_id", "ma", "mb"]).groupBy("case", "piece_id", "ma", "mb").agg(F.max_by(F.struct("oa", "ob"), F.struct("jaccard", "iou", -F.col("oa"), -F.col("ob"))).alias("o"))
    # Motifs without a common note: the occurrences that overlap most in time, the first ones if none do.
    a, b = (s.select("piece_id", F.col("motif").alias(f"m{x}"), F.col("occ").alias(f"o{x}"), F.col("start").alias(f"{x}0"), F.col("end").alias(f"{x}1")) for x in "ab")
    rest = two.join(first, ["case", "piece_id"], "left_anti").join(a, ["piece_id", "ma"]).join(b, ["piece_id", "mb"])
    rest = rest.groupBy("case", "piece_id", "ma", "mb").agg(F.max_by(F.struct("oa", "ob"), F.struct(time_iou(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1")), -F.col("oa"), -F.col("ob"))).alias("o"))
    pair = first.unionByName(rest).select("case", "piece_id", F.explode(F.array(F.struct(F.col("ma").alias("motif"), F.col("o.oa").alias("occ")), F.struct(F.col("mb").alias("motif"), F.col("o.ob").alias("occ")))).alias("x")).select("case", "piece_id", "x.*")
    alone = cases.where("mb is null").select("case", "piece_id", F.col("ma").alias("motif")).join(representative(motifs).select("piece_id", "motif", "occ"), ["piece_id", "motif"])
    focus = pair.unionByName(alone.select(*pair.columns)).join(s, ["piece_id", "motif", "occ"]).groupBy("case", "piece_id").agg((F.min("start") - pad).alias("low"), (F.max("end") + pad).alias("high"))
    if context <= 0:
        return focus.select("case", "piece_id", F.col("low").alias("start"), F.col("high").alias("end"))
    own = cases.select("case", "piece_id", F.posexplode(F.array("ma", "mb")).alias("nth", "motif")).where("motif is not null").join(s, ["piece_id", "motif"])
    spans = own.groupBy("case", "piece_id").agg(F.sort_array(F.collect_list(F.struct("nth", "occ", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end")))).alias("spans"))

    def grown(view, span):
        near = (span["end"] >= view["low"] - context) & (span["start"] <= view["high"] + context)
        low, high = F.least(view["low"], span["start"] - pad), F.greatest(view["high"], span["end"] + pad)
        return F.struct(F.when(near, low).otherwise(view["low"]).alias("low"), F.when(near, high).otherwise(view["high"]).alias("high"))

    out = focus.join(spans, ["case", "piece_id"]).withColumn("v", F.struct(F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high")))
    for _ in range(rounds):  # a round that changes nothing is a fixed point, so the others change nothing either
        out = out.withColumn("v", F.aggregate("spans", F.col("v"), grown))
    return out.select("case", "piece_id", F.col("v.low").alias("start"), F.col("v.high").alias("end"))


def pick_case(cases: DataFrame, index: int = 0, piece: object = None) -> DataFrame:
    """The case at a place (from 0) of a list of top cases, or of those of one piece; no row if there are fewer."""
    own = cases if piece is None else cases.where(F.col("piece_id") == piece)
    return own.withColumn("_k", F.row_number().over(Window.orderBy("place"))).where(F.col("_k") == index + 1).drop("_k")


def span_filled(spans: DataFrame, notes: DataFrame, width: int = 64) -> DataFrame:
    """Occurrences (piece_id, motif, occ, start, end) with all notes from start to end: (piece_id, motif, occ, onset, pitch).
    Both sides meet in stretches of `width`, so that no note is compared with every span."""
    at = lambda c: F.floor(F.col(c) / width).cast("long")
    s = spans.withColumn("stretch", F.explode(F.sequence(at("start"), at("end"))))
    n = notes.select("piece_id", "onset", "pitch", at("onset").alias("stretch"))
    return s.join(n, ["piece_id", "stretch"]).where("onset between start and end").select("piece_id", "motif", "occ", "onset", "pitch")
