"""Motif retrieval: hopping multi-scale windows, hashed n-gram vectors, a similarity graph, components, interval suppression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import bin_of, tempo_penalty, time_iou
from .graph import components, written
from .prep import note_beats


@dataclass(frozen=True)
class Config:
    """Parameters of the retrieval. The defaults are the dense multi-scale setting."""

    scales: Sequence[int] = (8, 16)
    hop: float = 0.25
    min_notes: int = 3
    top_k: int = 0
    similarity: float = 0.9
    max_iou: float = 0.25
    alpha: float = 1.0
    same_scale: bool = True
    keep_iou: float = 0.5
    keep_overlap: float = 1.0
    buckets: int = 256
    orders: Sequence[int] = (2, 3)
    pitch_bins: Sequence[float] = (-24, -12, -7, -5, -3, -2, -1, 0, 1, 2, 3, 5, 7, 12, 24)
    time_bins: Sequence[float] = field(default_factory=lambda: tuple(round(-2.5 + 0.2 * k, 6) for k in range(26)))


def membership(notes: DataFrame, cfg: Config, time: str = "onset") -> DataFrame:
    """(piece_id, seg, scale, start, end, onset, pitch): the notes of every kept window. Windows are of the column `time`, by default the onset.

    Windows of each scale start at the piece's first onset and every scale * hop from there, up to the last onset; they are half-open, and
    those with too few notes go. seg counts a piece's kept windows over all scales. A note makes its own window numbers,
    so there is no range join.
    """
    piece = Window.partitionBy("piece_id")
    spread = notes.select("piece_id", "onset", "pitch", F.col(time).alias("at"), F.min(time).over(piece).alias("first"), F.max(time).over(piece).alias("last"))
    spread = spread.select("*", F.explode(F.array(*(F.struct(F.lit(i).alias("scale_no"), F.lit(s).alias("scale"), F.lit(max(1, round(s * cfg.hop))).alias("step")) for i, s in enumerate(cfg.scales)))).alias("s")).select("piece_id", "onset", "pitch", "at", "first", "last", "s.*")
    at = F.col("at") - F.col("first")
    low = F.greatest(F.lit(0), F.floor((at - F.col("scale")) / F.col("step")) + 1)
    spread = spread.select("*", F.explode(F.sequence(low.cast("long"), F.floor(at / F.col("step")).cast("long"))).alias("k"))
    spread = spread.withColumn("start", F.col("first") + F.col("k") * F.col("step")).where("start <= last")
    w = spread.groupBy("piece_id", "scale_no", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= cfg.min_notes)
    w = w.select("piece_id", "scale_no", "k", (F.row_number().over(piece.orderBy("scale_no", "k")) - 1).alias("seg"))
    return spread.join(w, ["piece_id", "scale_no", "k"]).select("piece_id", "seg", "scale", "start", (F.col("start") + F.col("scale")).alias("end"), "onset", "pitch")


def beat_windows(notes: DataFrame, beats: DataFrame, cfg: Config) -> DataFrame:
    """As membership, for notes whose onsets are seconds: windows are of beats, found between beat times (piece_id, beat, at) and drawn on beyond both ends."""
    timed = note_beats(notes.withColumn("time", F.col("onset")), beats)
    return membership(timed, cfg, "beat")


def segments(members: DataFrame) -> DataFrame:
    return members.groupBy("piece_id", "seg", "scale", "start", "end").agg(F.count(F.lit(1)).alias("n_notes"))


def steps(members: DataFrame) -> DataFrame:
    """(piece_id, seg, scale, i, d_pitch, d_time, g): steps from note to note; d_time is the log of the time between, less its mean g in the segment."""
    w = Window.partitionBy("piece_id", "seg").orderBy("onset", "pitch")
    out = members.select("piece_id", "seg", "scale", F.row_number().over(w).alias("i"), (F.col("pitch") - F.lag("pitch").over(w)).alias("d_pitch"), F.log(F.greatest(F.col("onset") - F.lag("onset").over(w), F.lit(1e-4))).alias("t")).where("d_pitch is not null")
    g = F.round(F.avg("t").over(Window.partitionBy("piece_id", "seg")), 9)
    return out.select("piece_id", "seg", "scale", "i", "d_pitch", F.round(F.col("t") - g, 6).alias("d_time"), g.alias("g"))


def ngram_hash(first: int, tokens: Sequence[Column], buckets: int) -> Column:
    """A polynomial hash of tokens, in whole numbers that any engine can repeat."""
    h = F.lit(first).cast("long")
    for t in tokens:
        h = F.pmod(h * 1000003 + t, F.lit(2147483647))
    return F.pmod(h, F.lit(buckets))


def vectors(stepped: DataFrame, cfg: Config) -> DataFrame:
    """(piece_id, seg, scale, g, bucket, weight): counts of hashed n-grams of steps, over the vector's length. Order 2 also
    counts pairs with one step between."""
    w = Window.partitionBy("piece_id", "seg").orderBy("i")
    token = bin_of(F.col("d_pitch"), cfg.pitch_bins) * 32 + bin_of(F.col("d_time"), cfg.time_bins)
    t = stepped.select("piece_id", "seg", "scale", "g", "i", token.alias("t0"))
    t = t.select("*", F.lead("t0", 1).over(w).alias("t1"), F.lead("t0", 2).over(w).alias("t2"))
    grams = [F.when(F.col("t1").isNotNull(), ngram_hash(2, [F.col("t0"), F.col("t1")], cfg.buckets)), F.when(F.col("t2").isNotNull(), ngram_hash(3, [F.col("t0"), F.col("t2")], cfg.buckets)), F.when(F.col("t2").isNotNull(), ngram_hash(3, [F.col("t0"), F.col("t1"), F.col("t2")], cfg.buckets) + cfg.buckets)]
    c = t.select("piece_id", "seg", "scale", "g", F.explode(F.array(*grams)).alias("bucket")).where("bucket is not null").groupBy("piece_id", "seg", "scale", "g", "bucket").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("weight", F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("piece_id", "seg")).cast("double"))).drop("n")


def similarities(vecs: DataFrame, cfg: Config) -> DataFrame:
    """(piece_id, a, b, sim) of segments a < b that share a bucket: cosine times the tempo penalty. Others have similarity 0.
    With same_scale only segments of one scale meet, unless neighbours are ranked, which looks at all scales."""
    key = ["piece_id", "scale", "bucket"] if cfg.same_scale and not cfg.top_k else ["piece_id", "bucket"]
    a = vecs.select(*key, F.col("seg").alias("a"), F.col("g").alias("ga"), F.col("weight").alias("wa"))
    b = vecs.select(*key, F.col("seg").alias("b"), F.col("g").alias("gb"), F.col("weight").alias("wb"))
    dots = a.join(b, key).where("a < b").groupBy("piece_id", "a", "b", "ga", "gb").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    return dots.select("piece_id", "a", "b", (F.col("dot") * tempo_penalty(F.col("ga"), F.col("gb"), cfg.alpha)).alias("sim"))


def with_spans(sims: DataFrame, segs: DataFrame) -> DataFrame:
    for s in "ab":
        sims = sims.join(segs.select("piece_id", F.col("seg").alias(s), F.col("scale").alias(f"{s}_scale"), F.col("start").alias(f"{s}0"), F.col("end").alias(f"{s}1")), ["piece_id", s])
    return sims


def neighbours(sims: DataFrame, segs: DataFrame, k: int) -> DataFrame:
    """(piece_id, a, b, sim, rank): pairs a < b with the better of the two ranks that they give each other by similarity (rounded to 6 digits, ties to
    the smaller segment). Pairs of similarity 0 are there only where a segment has fewer than k others."""
    pairs = sims.select("piece_id", "a", "b", F.round("sim", 6).alias("sim"))
    both = pairs.unionByName(pairs.select("piece_id", F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    n = both.groupBy("piece_id", "a").agg(F.count(F.lit(1)).alias("n"))
    short = segs.select("piece_id", F.col("seg").alias("a"), F.count(F.lit(1)).over(Window.partitionBy("piece_id")).alias("all")).join(n, ["piece_id", "a"], "left").where(F.coalesce("n", F.lit(0)) < k)
    # Of the first 2k + 1 segments at most k are the segment itself or ranked already.
    fill = short.select("piece_id", "a", F.explode(F.sequence(F.lit(0), F.least(F.lit(2 * k), F.col("all") - 1).cast("int"))).alias("b")).where("a <> b")
    fill = fill.join(both.select("piece_id", "a", "b"), ["piece_id", "a", "b"], "left_anti").withColumn("sim", F.lit(0.0))
    ranked = both.unionByName(fill).withColumn("rank", F.row_number().over(Window.partitionBy("piece_id", "a").orderBy(F.desc("sim"), "b")))
    ranked = ranked.where((F.col("sim") > 0) | (F.col("rank") <= k))
    return ranked.groupBy("piece_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("sim").alias("sim"), F.min("rank").alias("rank"))


def edges(sims: DataFrame, segs: DataFrame, cfg: Config) -> DataFrame:
    """Edges (piece_id, a, b, sim) of pairs that don't overlap too much (with same_scale: of one scale) and are similar enough (rounded to 6 digits) or, with top_k,
    among the k most similar of one of their ends; ranks count all segments, whatever their scale and overlap."""
    pairs = neighbours(sims, segs, cfg.top_k) if cfg.top_k else sims.withColumn("sim", F.round("sim", 6)).withColumn("rank", F.lit(1))
    near = (F.col("sim") >= cfg.similarity) | (F.col("rank") <= cfg.top_k)
    out = with_spans(pairs, segs).where(near & (time_iou(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1")) < cfg.max_iou))
    return (out.where("a_scale = b_scale") if cfg.same_scale else out).select("piece_id", "a", "b", "sim")


def clusters(graph: DataFrame) -> DataFrame:
    """(piece_id, seg, component) of segments that have an edge."""
    nodes = graph.select("piece_id", F.col("a").alias("node")).unionByName(graph.select("piece_id", F.col("b").alias("node"))).distinct()
    found = components(nodes, graph.select("piece_id", F.col("a").alias("src"), F.col("b").alias("dst")))
    return found.withColumnRenamed("node", "seg")


def centrality(members: DataFrame, sims: DataFrame) -> DataFrame:
    """(piece_id, seg, component, score): mean similarity to all other members of the component, edge or not."""
    a, b = members.select("piece_id", "component", F.col("seg").alias("a")), members.select("piece_id", F.col("component").alias("cb"), F.col("seg").alias("b"))
    inner = sims.join(a, ["piece_id", "a"]).join(b, ["piece_id", "b"]).where("component = cb")
    each = inner.select("piece_id", F.col("a").alias("seg"), "sim").unionByName(inner.select("piece_id", F.col("b").alias("seg"), "sim")).groupBy("piece_id", "seg").agg(F.sum("sim").alias("total"))
    size = members.groupBy("piece_id", "component").agg(F.count(F.lit(1)).alias("size"))
    out = members.join(each, ["piece_id", "seg"], "left").join(size, ["piece_id", "component"])
    return out.select("piece_id", "seg", "component", F.when(F.col("size") > 1, F.coalesce("total", F.lit(0.0)) / (F.col("size") - 1)).otherwise(F.lit(0.0)).alias("score"))


def consolidate(scored: DataFrame, segs: DataFrame, cfg: Config) -> DataFrame:
    """Greedy interval suppression within each component: by falling score, a segment stays if it overlaps none that stays too much.

    Greedy order makes this one small group per component; a component's size is bounded by its piece's windows.
    """
    rows = scored.join(segs, ["piece_id", "seg"]).select("piece_id", "component", "seg", "start", "end", F.round("score", 6).alias("score"))

    def suppress(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple] = []
        for r in pdf.sort_values(["score", "seg"], ascending=[False, True]).itertuples():
            def free(k: tuple, r: tuple = r) -> bool:
                both = max(0, min(k.end, r.end) - max(k.start, r.start))
                return both / (max(k.end, r.end) - min(k.start, r.start)) < cfg.keep_iou and both / min(k.end - k.start, r.end - r.start) < cfg.keep_overlap

            if all(map(free, kept)):
                kept.append(r)
        return pdf[pdf.seg.isin([k.seg for k in kept])]

    return rows.groupBy("piece_id", "component").applyInPandas(suppress, rows.schema)


def compared(notes: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members, segments and similarities of notes, each written once for all that reads it."""
    members = written(membership(notes, cfg))
    return members, written(segments(members)), written(similarities(vectors(steps(members), cfg), cfg))


def predict(notes: DataFrame, cfg: Config) -> DataFrame:
    """Motifs of every piece, point by point: (piece_id, motif, occurrence, onset, pitch), of components that keep at least two segments."""
    members, segs, sims = compared(notes, cfg)
    scored = centrality(clusters(written(edges(sims, segs, cfg))), sims)
    kept = consolidate(scored, segs, cfg)
    kept = kept.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("piece_id", "component"))).where("n > 1").select("piece_id", "seg", F.col("component").alias("motif"))
    return kept.join(members, ["piece_id", "seg"]).select("piece_id", "motif", F.col("seg").alias("occurrence"), "onset", "pitch")


def sweep(sims: DataFrame, segs: DataFrame, thresholds: Sequence[float], ious: Sequence[float]) -> DataFrame:
    """Edges of each piece for every pair of a similarity threshold and an overlap bound: (piece_id, similarity, iou, n_edges)."""
    grid = F.array(*(F.struct(F.lit(float(s)).alias("similarity"), F.lit(float(i)).alias("iou")) for s in thresholds for i in ious))
    pairs = with_spans(sims, segs).select("piece_id", F.round("sim", 6).alias("sim"), time_iou(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1")).alias("span_iou"), F.explode(grid).alias("p"))
    return pairs.groupBy("piece_id", "p.similarity", "p.iou").agg(F.sum(F.when((F.col("sim") >= F.col("p.similarity")) & (F.col("span_iou") < F.col("p.iou")), 1).otherwise(0)).alias("n_edges"))


def subgraph(graph: DataFrame, clustered: DataFrame) -> DataFrame:
    """Edges in and around each piece's largest component (ties: the least): (piece_id, a, b, sim, inner)."""
    size = clustered.groupBy("piece_id", "component").agg(F.count(F.lit(1)).alias("n"))
    best = size.groupBy("piece_id").agg(F.max(F.struct("n", (-F.col("component")).alias("m"))).alias("b")).select("piece_id", (-F.col("b.m")).alias("component"))
    core = clustered.join(best, ["piece_id", "component"], "left_semi").select("piece_id", "seg")
    a, b = core.select("piece_id", F.col("seg").alias("a"), F.lit(1).alias("in_a")), core.select("piece_id", F.col("seg").alias("b"), F.lit(1).alias("in_b"))
    out = graph.join(a, ["piece_id", "a"], "left").join(b, ["piece_id", "b"], "left").where("in_a is not null or in_b is not null")
    return out.select("piece_id", "a", "b", "sim", (F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("inner"))


def sweep_top(sims: DataFrame, segs: DataFrame, thresholds: Sequence[float], ious: Sequence[float], tops: Sequence[int], same_scale: bool = True) -> DataFrame:
    """Edges of each piece for every similarity, overlap bound and number of neighbours (0: none): (piece_id, similarity, iou, top_k, n_edges,
    n_segments). A pair counts if it is similar enough or ranks high enough, as in edges."""
    grid = F.array(*(F.struct(F.lit(float(s)).alias("similarity"), F.lit(float(i)).alias("iou"), F.lit(k).alias("top_k")) for s in thresholds for i in ious for k in tops))
    pairs = with_spans(neighbours(sims, segs, max(tops)), segs)
    pairs = (pairs.where("a_scale = b_scale") if same_scale else pairs).select("piece_id", "a", "b", "sim", "rank", time_iou(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1")).alias("span_iou"), F.explode(grid).alias("p"))
    kept = pairs.where(((F.col("sim") >= F.col("p.similarity")) | (F.col("rank") <= F.col("p.top_k"))) & (F.col("span_iou") < F.col("p.iou")))
    key = ["piece_id", "similarity", "iou", "top_k"]
    n = kept.select("piece_id", "p.*", "a", "b")
    ends = n.select(*key, F.explode(F.array("a", "b")).alias("seg"))
    return n.groupBy(*key).agg(F.count(F.lit(1)).alias("n_edges")).join(ends.groupBy(*key).agg(F.count_distinct("seg").alias("n_segments")), key)
