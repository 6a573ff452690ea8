"""Rules of covers, audits and neighbours on small cases that other rules would answer otherwise."""

import random

import pytest

from cantus.operators import audit, cover, retrieval
from cantus.operators import geometry as g
from test_geometry import brute_tecs, points


def motif(m, *occurrences):
    return [(0, m, k, o, p) for k, occ in enumerate(occurrences) for o, p in occ]


def frame(spark, *rows):
    return spark.createDataFrame([r for rs in rows for r in rs], "piece_id long, motif long, occ long, onset long, pitch long")


def test_overlap_in_time_alone_counts(spark):
    m = frame(spark, motif(1, [(0, 60), (10, 61)]), motif(2, [(0, 70), (10, 71)], [(90, 70), (99, 71)]), motif(3, [(40, 60), (44, 61)]))
    assert [tuple(r) for r in audit.best_overlap(m).collect()] == [(0, 1, 2, 0.0, 1.0)]
    s = audit.piece_summary(m).first()
    assert (s.near_duplicates, s.subset_pairs) == (1, 1)  # in time, not in notes
    assert s.mean_jaccard == 0 and s.mean_iou == pytest.approx(1 / 3)  # over all three pairs
    assert [tuple(r) for r in audit.top_duplicates(m).select("ma", "mb", "jaccard", "iou").collect()] == [(1, 2, 0.0, 1.0)]


def test_the_best_pair_is_the_one_with_most_common_notes(spark):
    m = frame(spark, motif(1, [(0, 60), (10, 61)], [(20, 60), (22, 62), (24, 64)]), motif(2, [(0, 70), (10, 71)], [(20, 60), (30, 61)]))
    r = audit.best_overlap(m).first()
    assert r.jaccard == pytest.approx(1 / 4) and r.iou == pytest.approx(4 / 10)  # not the pair that overlaps wholly in time


def test_means_are_of_motifs_and_sparse_motifs_are_judged_by_their_longest_span(spark):
    m = frame(spark, motif(1, [(0, 60), (20, 61)], [(30, 60), (31, 61)], [(40, 60), (41, 61)]), motif(2, [(0, 1), (1, 2), (2, 3), (3, 4)]))
    s = audit.piece_summary(m, sparse=4.0).first()
    assert s.mean_span == pytest.approx(((20 + 1 + 1) / 3 + 3) / 2) and s.mean_notes == 3
    assert s.n_sparse == 1
    assert [(r.motif, r.ratio) for r in audit.top_sparse(m).collect()] == [(1, 10.0)]
    assert audit.piece_summary(m, sparse=10.0).first().n_sparse == 1 and audit.piece_summary(m, sparse=10.1).first().n_sparse == 0
    several = m.unionByName(m.where("motif = 1").selectExpr("5L as piece_id", "motif", "occ", "onset", "pitch"))
    assert [tuple(r) for r in audit.top_explosions(several, 2).select("place", "piece_id", "n_motifs").collect()] == [(1, 0, 2), (2, 5, 1)]


def closure(view, spans, pad, context):
    low, high = view[0] - pad, view[1] + pad
    for _ in range(3):
        before = low, high
        for a, b in spans:
            if b >= low - context and a <= high + context:
                low, high = min(low, a - pad), max(high, b + pad)
        if (low, high) == before:
            break
    return low, high


def test_views_take_in_spans_for_three_rounds(spark):
    chain = [[(o, 60), (o + 1, 61)] for o in range(100, 0, -5)] + [[(o, 60), (o + 1, 61), (o + 1, 62)] for o in (100,)]
    m = frame(spark, motif(1, *chain), motif(2, [(200, 60), (204, 61)], [(300, 1), (301, 2), (302, 3)], [(305, 1), (307, 2)]), motif(3, [(201, 99), (204, 98)]))
    cases = spark.createDataFrame([(0, 0, 1, None), (1, 0, 2, 3), (2, 0, 2, None)], "case long, piece_id long, ma long, mb long")
    spans = lambda k: [(min(o for o, _ in x), max(o for o, _ in x)) for x in k]
    got = {r.case: (r.start, r.end) for r in audit.views(m, cases, pad=0.5, context=3.0).collect()}
    assert got[0] == closure((100, 101), spans(chain), 0.5, 3.0)
    assert got[1] == closure((200, 204), [(200, 204), (300, 302), (305, 307), (201, 204)], 0.5, 3.0) == (199.5, 204.5)
    assert got[2] == closure((300, 302), [(200, 204), (300, 302), (305, 307)], 0.5, 3.0) == (299.5, 307.5)
    short = frame(spark, motif(1, *[[(o, 60), (o + 1, 61)] for o in range(0, 100, 4)], [(95, 1), (96, 2), (96, 3)]))
    r = audit.views(short, cases.where("case = 0"), pad=0.5, context=3.0).first()
    assert (r.start, r.end) == closure((95, 96), [*[(o, o + 1) for o in range(0, 100, 4)], (95, 96)], 0.5, 3.0) == (83.5, 97.5)  # the chain goes on, the rounds don't
    assert audit.views(m, cases.where("case = 1"), pad=1.0, context=0).first().end == 205


def brute_edges(sims, segs, cfg):
    """Links by threshold or rank, as full matrices."""
    n, out = len(segs), set()
    full = {(a, b): sims.get((min(a, b), max(a, b)), 0.0) for a in range(n) for b in range(n) if a != b}
    for a in range(n):
        top = sorted((b for b in range(n) if b != a), key=lambda b: (-full[a, b], b))[: cfg.top_k]
        for b in range(n):
            if a == b or cfg.same_scale and segs[a][0] != segs[b][0]:
                continue
            (_, s, e), (_, u, v) = segs[a], segs[b]
            if max(0, min(e, v) - max(s, u)) / (max(e, v) - min(s, u)) < cfg.max_iou and (full[a, b] >= cfg.similarity or b in top):
                out.add((min(a, b), max(a, b)))
    return out


@pytest.mark.parametrize("same_scale", [True, False])
def test_neighbours_are_linked_below_the_threshold(spark, same_scale):
    r = random.Random(3)
    segs = [(r.choice((4, 8)), s, s + 6) for s in (r.randrange(60) for _ in range(14))]
    sims = {(a, b): round(r.random(), 3) for a in range(14) for b in range(a + 1, 14) if r.random() < 0.3 and 13 not in (a, b)}  # 13 has nothing in common with any
    frames = spark.createDataFrame([(7, a, b, s) for (a, b), s in sims.items()], "piece_id long, a int, b int, sim double"), spark.createDataFrame([(7, k, *s) for k, s in enumerate(segs)], "piece_id long, seg int, scale int, start long, end long")
    for top, threshold in ((0, 0.5), (2, 0.7), (5, 2.0), (20, 2.0)):
        cfg = retrieval.Config(top_k=top, similarity=threshold, max_iou=0.5, same_scale=same_scale)
        got = {(x.a, x.b) for x in retrieval.edges(*frames, cfg).collect()}
        assert got == brute_edges(sims, segs, cfg) and (top == 0 or threshold < 1 or got)
    want = {(t, k): len(brute_edges(sims, segs, retrieval.Config(top_k=k, similarity=t, max_iou=0.5, same_scale=same_scale))) for t in (0.3, 0.9) for k in (0, 1, 4)}
    swept = retrieval.sweep_top(*frames, (0.3, 0.9), (0.5,), (0, 1, 4), same_scale).collect()
    assert {(x.similarity, x.top_k): x.n_edges for x in swept} == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("least,overlap", [(2, 0.5), (4, 0.2), (6, 0.9), (200, 0.5)])
def test_cover_by_gain(spark, least, overlap):
    r = random.Random(4)
    sets = [sorted({(r.randrange(9), r.randrange(5)) for _ in range(24)}) for _ in range(3)]
    n = points(spark, *sets)
    salience = {(x.piece_id, x.d_onset, x.d_pitch): x.salience for x in g.salience(g.measured(g.siatec(n), n), n).collect()}
    want = set()
    for k, s in enumerate(sets):
        left = {v: c for _, v, _, _, c in brute_tecs(s)}
        have, primary, step = set(), [], 0
        while have != set(s):
            left = {v: c for v, c in left.items() if len(c - have) >= least}  # for good
            best = max(left, key=lambda v: (len(left[v] - have) * salience[k, *v], -v[0], -v[1]), default=None)
            if best is None or len(left[best] - have) * salience[k, *best] <= 0:
                break
            c = left.pop(best)
            of = next((p for p, q in primary if len(q & c) / len(q) > overlap), step)
            primary += [(step, c)] if of == step else []
            want.add((k, *best, step, len(c - have), of, of != step))
            have, step = have | c, step + 1
    got = cover.forth(n, least, overlap).select("piece_id", "d_onset", "d_pitch", "step", "new_points", "primary_step", "secondary").collect()
    assert {tuple(x) for x in got} == want and (least > 6 or want)
