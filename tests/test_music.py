"""Scalars, windows, graphs, evaluation, tokens, preparation, cotexts and the encoder."""

import itertools
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cantus.functions import scalar as fn
from cantus.operators import audit, cotext, encoder, evaluate, prep, retrieval, tokens
from cantus.operators.graph import components


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_scalars(spark):
    lit = F.lit
    v = lambda c: value(spark, c)
    assert v(fn.time_iou(lit(0), lit(4), lit(2), lit(6))) == pytest.approx(2 / 6) and v(fn.time_iou(lit(0), lit(1), lit(3), lit(4))) == 0
    assert v(fn.overlap_ratio(lit(0), lit(4), lit(2), lit(4))) == 1
    assert [v(fn.bin_of(lit(x), (-1, 0, 1))) for x in (-5, -0.5, 0, 1, 9)] == [0, 0, 1, 1, 1]
    assert v(fn.jaccard(lit(0), lit(0), lit(0))) == 1 and v(fn.jaccard(lit(0), lit(2), lit(0))) == 0
    assert [v(fn.scale_of(lit(x), (2, 4, 8))) for x in (2, 2.1, 9)] == ["2", "4", ">8"]
    assert [v(fn.nearest(lit(d), 60, 64)) for d in (60, 90, 91, 10000)] == [0, 0, 1, 63]
    assert [tuple(map(v, fn.degree(lit(t)))) for t in ("1", "-2", "+4", "5/5")] == [(0, 0), (15, 0), (10, 0), (4, 4)]
    assert v(fn.centibeat(lit(0.025))) == 2 and v(fn.centibeat_floor(lit(1.239))) == 123 and v(fn.pitch_name(lit(61))) == "C#"
    steps = v(fn.vec(F.array(*(F.struct(lit(x).alias("onset"), lit(y).alias("pitch")) for x, y in ((0, 0), (0, 2), (1, 1))))))
    assert [tuple(s) for s in steps] == [(0, 2), (1, -1)]


def test_windows(spark):
    n = spark.createDataFrame([(0, t, 60 + t) for t in range(5)], "piece_id long, onset long, pitch long")
    segs = retrieval.segments(retrieval.membership(n, retrieval.Config(scales=(4,)))).orderBy("seg").collect()
    assert [(s.seg, s.start, s.end, s.n_notes) for s in segs] == [(0, 0, 4, 4), (1, 1, 5, 4), (2, 2, 6, 3)]


def test_components_partition_the_nodes(spark):
    r = random.Random(1)
    edges = [(p, r.randrange(20), r.randrange(20)) for p in (1, 2) for _ in range(12)]
    nodes = spark.createDataFrame([(p, k) for p in (1, 2) for k in range(20)], "piece_id long, node long")
    found = {(x.piece_id, x.node): x.component for x in components(nodes, spark.createDataFrame(edges, "piece_id long, src long, dst long")).collect()}
    label = {(p, k): k for p in (1, 2) for k in range(20)}
    for _ in range(40):
        for p, a, b in edges:
            label[p, a] = label[p, b] = min(label[p, a], label[p, b])
    assert found == label


def test_suppression_keeps_apart(spark):
    segs = spark.createDataFrame([(0, k, 8, 2 * k, 2 * k + 8, 5) for k in range(12)], "piece_id long, seg long, scale int, start long, end long, n_notes long")
    scored = spark.createDataFrame([(0, k, 0, float((7 * k) % 12)) for k in range(12)], "piece_id long, seg long, component long, score double")
    kept = retrieval.consolidate(scored, segs, retrieval.Config(keep_iou=0.3, keep_overlap=0.5)).collect()
    for a, b in itertools.combinations(kept, 2):
        both = max(0, min(a.end, b.end) - max(a.start, b.start))
        assert both / (max(a.end, b.end) - min(a.start, b.start)) < 0.3


def test_a_repeated_motif_is_retrieved(spark):
    tune = [(0, 60), (1, 64), (2, 62), (4, 67), (5, 65), (6, 60), (7, 72)]
    rows = [(0, 40 * k + t, p + k) for k in range(3) for t, p in tune]
    found = retrieval.predict(spark.createDataFrame(rows, "piece_id long, onset long, pitch long"), retrieval.Config(scales=(8,)))
    assert found.select("motif", "occurrence").distinct().count() >= 3


def sets(spark, rows):
    return spark.createDataFrame(rows, "piece_id long, pattern string, occ long, onset long, pitch long")


def test_metrics(spark):
    ref = sets(spark, [(0, "a", 0, 1, 1), (0, "a", 0, 2, 2), (0, "a", 1, 11, 1), (0, "a", 1, 12, 2), (0, "b", 0, 5, 5)])
    far = sets(spark, [(0, "z", 0, 100, 1)])
    for est, want in ((ref, 1.0), (far, 0.0)):
        m = evaluate.score_matrix(ref, est)
        for layer in (evaluate.establishment(m), evaluate.occurrence(m), evaluate.three_layer(m)):
            assert [round(x, 9) for x in layer.select("precision", "recall", "f1").first()] == [want] * 3
    moved = ref.withColumn("onset", F.col("onset") + 7)
    assert tuple(evaluate.translational(ref, moved).select("precision", "recall").first()) == (1.0, 1.0)
    c = evaluate.confusion(spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 1)], "t int, g int"), F.col("t"), F.col("g")).first()
    assert (c.tp, c.fp, c.fn, c.tn, c.accuracy, c.f1) == (1, 1, 1, 1, 0.5, 0.5)


def test_means_halfway_between_two_figures_are_rounded_up(spark):
    tune = [(t, 60 + t) for t in range(20)]
    found = ((7, 6), (7, 14), (14, 3))  # notes of the tune in 31 occurrences and in the last; sums of such doubles are too small in any order
    ref = sets(spark, [(k, "a", 0, o, p) for k in range(len(found)) for o, p in tune])
    est = sets(spark, [(k, "z", i, o, p) for k, (n, last) in enumerate(found) for i in range(32) for o, p in tune[: last if i == 31 else n]])
    got = evaluate.occurrence(evaluate.score_matrix(ref, est), 0.1)
    assert [tuple(r) for r in got.select("precision", "recall").orderBy("piece_id").collect()] == [((31 * n + last) / 640, max(n, last) / 20) for n, last in found]
    assert [r.x for r in got.orderBy("piece_id").select(F.round("precision", 6).alias("x")).collect()] == [0.348438, 0.360938, 0.682813]


def exact_occurrence(matrix, threshold):
    """(precision, recall) of a piece in fractions."""
    best, col, row = defaultdict(Fraction), defaultdict(lambda: defaultdict(Fraction)), defaultdict(lambda: defaultdict(Fraction))
    for rp, ro, ep, eo, shared, nr, ne in matrix:
        x = Fraction(shared, max(nr, ne))
        best[rp, ep] = max(best[rp, ep], x)
        col[rp, ep][eo], row[rp, ep][ro] = max(col[rp, ep][eo], x), max(row[rp, ep][ro], x)
    cells = [c for c, x in best.items() if x >= threshold]
    mean = lambda xs: sum(xs, Fraction(0)) / max(len(xs), 1)
    p = [max(mean(list(col[c].values())) for c in cells if c[1] == ep) for _, ep in cells]
    r = [max(mean(list(row[c].values())) for c in cells if c[0] == rp) for rp, _ in cells]
    return float(mean(p)), float(mean(r))


def test_occurrence_metric_is_the_nearest_double_in_any_order(spark):
    r, rows = random.Random(3), []
    for piece in range(12):
        ref, est = ([(p, o, r.randrange(1, 13)) for p in range(3) for o in range(r.randrange(1, 8))] for _ in range(2))
        rows += [(piece, rp, ro, ep, eo, r.randrange(min(nr, ne) + 1), nr, ne) for rp, ro, nr in ref for ep, eo, ne in est]
    want = [exact_occurrence([x[1:] for x in rows if x[0] == piece], Fraction(1, 2)) for piece in range(12)]
    for parts in (1, 5):
        r.shuffle(rows)
        m = spark.createDataFrame(rows, "piece_id long, rp long, ro long, ep long, eo long, shared long, nr long, ne long").repartition(parts)
        got = evaluate.occurrence(m.withColumn("score", F.col("shared") / F.greatest("nr", "ne")), 0.5)
        assert [tuple(x) for x in got.orderBy("piece_id").select("precision", "recall").collect()] == want


def test_audit(spark):
    m = spark.createDataFrame([(0, 1, 0, 0, 60), (0, 1, 0, 4, 62), (0, 2, 0, 0, 60), (0, 2, 0, 4, 62), (0, 2, 1, 9, 60)], "piece_id long, motif long, occ long, onset long, pitch long")
    s = audit.piece_summary(m).first()
    assert (s.n_motifs, s.n_occurrences, s.near_duplicates, s.subset_pairs, s.max_span) == (2, 3, 1, 1, 4)
    assert audit.representative(m).where("motif = 2").first().occ == 0


def test_occurrences_of_a_motif_beyond_the_sixth(spark):
    """Eight occurrences: the last two are the smallest, equal in notes; times overlap without shared notes too."""
    rows = [(0, 1, k, 100 * k + t, 60) for k in range(6) for t in range(4)] + [(0, 1, k, t, 61) for k in (6, 7) for t in (0, 3)]
    g = audit.within_motif(spark.createDataFrame(rows, "piece_id long, motif long, occ long, onset long, pitch long")).first()
    assert (g.max_jaccard, g.max_iou) == (1.0, 1.0)
    assert abs(g.mean_jaccard - 1 / 28) < 1e-9 and abs(g.mean_iou - 3 / 28) < 1e-9


def test_chunks(spark):
    w = spark.range(600).select(F.lit(0).alias("piece_id"), F.col("id").alias("w"))
    rows = tokens.padding(tokens.chunks(w, 128)).orderBy("chunk").collect()
    assert [(r.chunk, r.n_words, r.n_padding) for r in rows] == [(0, 384, 128), (1, 216, 296)]


def test_bars_reach_beyond_both_ends(spark):
    b = tokens.bars(spark.createDataFrame([(0, 4.0), (0, 8.0), (0, 12.0)], "piece_id long, downbeat double")).orderBy("start").collect()
    assert [(x.start, x.end) for x in b] == [(0, 4), (4, 8), (8, 12), (12, 16)]


def test_folds(spark):
    p = spark.range(1, 33).withColumnRenamed("id", "piece_id")
    got = [r.fold for r in tokens.folds(p, F.col("piece_id") - 1).orderBy("piece_id").collect()]
    assert got == [0] * 7 + [1] * 7 + [2] * 6 + [3] * 6 + [4] * 6


def test_as_of_and_tempo(spark):
    left = spark.createDataFrame([(0, 1), (0, 5), (0, 9)], "p long, t long")
    right = spark.createDataFrame([(0, 5, "x"), (0, 7, "y")], "p long, at long, v string")
    assert [r.v for r in prep.as_of(left, right, "p", "t", "at", ["v"]).orderBy("t").collect()] == [None, "x", "y"]
    assert [r.v for r in prep.as_of(left, right, "p", "t", "at", ["v"], strict=True).orderBy("t").collect()] == [None, None, "y"]
    s = prep.note_seconds(spark.createDataFrame([(0, 0), (0, 480), (0, 960)], "piece_id long, tick long"), spark.createDataFrame([(0, 0, 60), (0, 480, 120)], "piece_id long, tick long, bpm int"))
    assert [r.seconds for r in s.orderBy("tick").collect()] == [0.0, 1.0, 1.5]


def test_skyline(spark):
    n = spark.createDataFrame([(0, 0, 480, 60), (0, 0, 480, 72), (0, 240, 480, 50), (0, 480, 960, 64), (0, 960, 1200, 76), (0, 1440, 1680, 70)], "piece_id long, start long, end long, pitch long")
    got = [(r.start, r.end, r.pitch) for r in prep.skyline(n).orderBy("start").collect()]
    assert got == [(0, 480, 72), (480, 960, 64), (960, 1200, 76)] or got == [(0, 480, 72), (960, 1200, 76)]


def test_tempo_changes_keep_what_deviates(spark):
    b = spark.createDataFrame([(0, k, x) for k, x in enumerate((0.5, 0.52, 0.54, 0.58, 0.58, 0.5))], "piece_id long, beat long, length double")
    assert [r.beat for r in prep.tempo_changes(b).orderBy("beat").collect()] == [0, 3, 5]


def test_cotexts_find_a_repetition(spark):
    tune = [(0, 60), (1, 62), (2, 64), (3, 65), (4, 67)]
    rows = [(0, 20 * k + t, p, 0) for k in range(3) for t, p in tune]
    found = cotext.discover(spark.createDataFrame(rows, "piece_id long, onset long, pitch long, staff int"), cotext.Tolerance(pitch=0, min_notes=4))
    best = found.groupBy("motif").agg(F.count_distinct("occurrence").alias("n")).agg(F.max("n")).first()[0]
    assert best == 3


def test_encoder_ignores_padding_and_gives_unit_vectors():
    w = encoder.random_weights()
    x = np.random.default_rng(0).normal(size=(3, 5, 2))
    longer = np.concatenate([x, np.full((3, 4, 2), 9.0)], 1)
    a = encoder.encode(x, np.ones((3, 5), bool), w)
    b = encoder.encode(longer, np.arange(9)[None, :].repeat(3, 0) < 5, w)
    assert np.allclose(a, b) and np.allclose(np.linalg.norm(a, axis=1), 1)
