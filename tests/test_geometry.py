"""Golden point sets of the translational algorithms, and what must hold on any set."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from cantus.operators import cover
from cantus.operators import geometry as g
from cantus.sources.notes import collinear, triangular

G1 = [(1, 2), (2, 1), (3, 3), (4, 2)]
G2 = [(1, 1), (1, 3), (2, 1), (2, 2), (2, 3), (3, 2)]


def points(spark, *sets):
    return spark.createDataFrame([(k, x, y) for k, s in enumerate(sets) for x, y in s], "piece_id long, onset long, pitch long")


def as_set(rows):
    return [tuple(p) for p in rows]


def brute_mtps(s):
    out = {}
    for a, b in itertools.combinations(sorted(s), 2):
        out.setdefault((b[0] - a[0], b[1] - a[1]), []).append(a)
    return {k: sorted(v) for k, v in out.items()}


def test_mtps_of_the_golden_sets(spark):
    found = {}
    for r in g.mtps(points(spark, G1, G2)).collect():
        found.setdefault(r.piece_id, {})[r.d_onset, r.d_pitch] = as_set(r.pattern)
    assert found[0] == {(2, 1): [(1, 2), (2, 1)], (1, -1): [(1, 2), (3, 3)], (3, 0): [(1, 2)], (1, 2): [(2, 1)]}
    assert found[1] == brute_mtps(G2) and len(found[1]) == 9


def test_tecs_of_the_golden_set(spark):
    tecs = [(as_set(r.pattern), as_set(r.translators)) for r in g.siatec(points(spark, G2)).collect()]
    covers = sorted((len(p), len(t), sorted({(a + c, b + d) for a, b in p for c, d in t})) for p, t in tecs)
    golden = [([(1, 3)], [(0, -2), (0, 0), (1, -2), (1, -1), (1, 0), (2, -1)]), ([(2, 1), (2, 2)], [(0, 0), (0, 1)]), ([(1, 1), (2, 1)], [(0, 0), (0, 2), (1, 1)]), ([(1, 1), (1, 3), (2, 2)], [(0, 0), (1, 0)])]
    assert covers == sorted((len(p), len(t), sorted({(a + c, b + d) for a, b in p for c, d in t})) for p, t in golden)


def test_translators_are_all_that_fit(spark):
    r = random.Random(3)
    s = sorted({(r.randrange(8), r.randrange(5)) for _ in range(25)})
    for t in g.siatec(points(spark, s)).collect():
        p = as_set(t.pattern)
        every = {(x - p[0][0], y - p[0][1]) for x, y in s}
        assert set(as_set(t.translators)) == {v for v in every if all((a + v[0], b + v[1]) in s for a, b in p)}


def test_measures(spark):
    s = [(x, y) for x in (1, 3, 5) for y in (1, 3, 5)] + [(9, 9), (0, 0)]
    tecs = spark.createDataFrame([(0, 0, 0, [(1, 3), (3, 5), (5, 1), (5, 3)], 4, [(0, 0)], 1)], "piece_id long, d_onset long, d_pitch long, pattern array<struct<onset:long,pitch:long>>, size int, translators array<struct<onset:long,pitch:long>>, n_translators int")
    m = g.measured(tecs, points(spark, s)).first()
    assert m.compactness == pytest.approx(4 / 9) and m.width == 4 and m.volume == 16 and m.coverage == 4 and m.cr == 1
    two = spark.createDataFrame([(0, 0, 0, [(2, 1), (2, 2)], 2, [(0, 0), (1, 1)], 2)], tecs.schema)
    assert {(r.onset, r.pitch) for r in g.covered(two).collect()} == {(2, 1), (2, 2), (3, 2), (3, 3)}


def test_filters_before_and_after_agree(spark):
    r = random.Random(5)
    n = points(spark, {(r.randrange(10), r.randrange(6)) for _ in range(30)}).cache()
    key = lambda df: sorted((x.d_onset, x.d_pitch, x.coverage) for x in df.collect())
    assert key(g.siatech_pf(n, 1.5)) == key(g.siatechf(n, 1.5)) != []


def test_siar_finds_a_part_of_the_mtps(spark):
    full = brute_mtps(G2)
    for r in g.siar(points(spark, G2), 3).collect():
        assert full[r.d_onset, r.d_pitch] == as_set(r.pattern)


def test_conjugate_covers_the_same(spark):
    t = g.siatec(points(spark, G2)).where("size >= 2")
    cover_of = lambda df: sorted((r.d_onset, r.d_pitch, r.onset, r.pitch) for r in g.covered(df).collect())
    assert cover_of(t) == cover_of(g.conjugate(t))


def test_extremal_sets(spark):
    assert g.mtps(collinear(spark, 12)).count() == 11
    assert g.mtps(triangular(spark, 12)).count() == 66


def test_cardinality_up_to_translation(spark):
    p, q = [(1, 1), (1, 3), (1, 4), (2, 2), (3, 1), (4, 1), (4, 4)], [(3, 4), (3, 6), (3, 7), (4, 2), (5, 4), (5, 5), (6, 7), (7, 1)]
    sets = [spark.createDataFrame([(0, k, x, y) for x, y in s], "piece_id long, set_id long, onset long, pitch long") for k, s in enumerate((p, q))]
    assert g.cardinality(*sets, translate=True).first().score == pytest.approx(5 / 8)


def test_covers_reach_every_point(spark):
    n = points(spark, G2)
    taken = cover.compress(n)
    rest = {(r.onset, r.pitch) for r in cover.residual(n, taken).collect()}
    tecs = g.siatec(n)
    have = {(r.onset, r.pitch) for r in g.covered(tecs.join(taken.select("piece_id", "d_onset", "d_pitch"), ["piece_id", "d_onset", "d_pitch"])).collect()}
    assert have | rest == set(G2)
    rounds = cover.cosiatec(n).collect()
    assert {(r.onset, r.pitch) for r in rounds} == set(G2) and len(rounds) == len(G2)
    assert cover.forth(n, least_new=1).count() >= 1


def test_trawl_cuts_where_points_grow_sparse(spark):
    s = [(0, 0), (1, 0), (2, 0), (5, 1), (5, 2), (5, 3), (10, 0), (11, 0), (12, 0)]
    parts = cover.trawl(points(spark, s), 0.6, 2).where("d_onset = 1 and d_pitch = 0").collect()
    assert [p["size"] for p in parts] == [2]
    assert cover.trawl(points(spark, s), 0.01, 2).where(F.col("part") > 0).count() == 0


def test_empty_set(spark):
    n = points(spark)
    assert g.siatec(n).count() == 0 and g.measured(g.siatec(n), n).count() == 0


def brute_tecs(s, among=None, conjugates=False):
    """One pattern per shape (of the smallest vector) with translators, coverage and the keys that rank it among the points `among`; with conjugates, those too."""
    s = sorted(s)
    among = among or s
    by_shape = {}
    for v, p in sorted(brute_mtps(s).items()):
        by_shape.setdefault(tuple((a - p[0][0], b - p[0][1]) for a, b in p), (v, p))
    for v, p in by_shape.values():
        t = [(x - p[0][0], y - p[0][1]) for x, y in s if all((a + x - p[0][0], b + y - p[0][1]) in s for a, b in p)]
        conj = sorted((p[0][0] + c, p[0][1] + d) for c, d in t), [(a - p[0][0], b - p[0][1]) for a, b in p]
        for other, (p, t) in enumerate([(p, t), conj] if conjugates else [(p, t)]):
            cover = {(a + c, b + d) for a, b in p for c, d in t}
            xs, ys = [a for a, _ in p], [b for _, b in p]
            width, height = max(xs) - min(xs), max(ys) - min(ys)
            box = sum(min(xs) <= x <= max(xs) and min(ys) <= y <= max(ys) for x, y in among)
            key = (-len(cover) / (len(p) + len(t) - 1), -len(p) / box, -len(cover), -len(p), width, width * height, *v, other)
            yield key, v, len(p), len(t), cover


def test_compress_takes_what_a_greedy_scan_takes(spark):
    r = random.Random(9)
    sets = [sorted({(r.randrange(12), r.randrange(5)) for _ in range(22)}) for _ in range(3)]
    for strict, conjugates in ((False, False), (True, False), (False, True)):
        want = set()
        for k, s in enumerate(sets):
            have, step = set(), 0
            for key, v, n, t, cover_ in sorted(brute_tecs(s, s, conjugates)):
                if len(cover_ - have) > n + t - (0 if strict else 1):
                    want.add((k, *v, bool(key[-1]), step, len(cover_ - have)))
                    have, step = have | cover_, step + 1
                    if len(have) == len(s):
                        break
        assert {tuple(x) for x in cover.compress(points(spark, *sets), strict, conjugates).collect()} == want


@pytest.mark.parametrize("conjugates", [True, False])
def test_cosiatec_takes_the_best_class_of_what_is_left(spark, conjugates):
    r = random.Random(11)
    sets = [sorted({(r.randrange(10), r.randrange(4)) for _ in range(14)}) for _ in range(2)]
    want = set()
    for k, s in enumerate(sets):
        left, step = set(s), 0
        while left:
            if len(left) == 1:
                taken, name = set(left), (0, 0, False)
            else:
                key, v, _, _, cover_ = min(brute_tecs(left, s, conjugates))
                taken, name = cover_ & left, (*v, bool(key[-1]))
            want |= {(k, *p, step, *name) for p in taken}
            left, step = left - taken, step + 1
    got = cover.cosiatec(points(spark, *sets), conjugates).select("piece_id", "onset", "pitch", "round", "d_onset", "d_pitch", "conjugate").collect()
    assert {tuple(x) for x in got} == want


def test_long_pieces_are_paired_in_blocks(spark, monkeypatch):
    r = random.Random(2)
    n = points(spark, {(r.randrange(40), r.randrange(12)) for _ in range(90)}, {(r.randrange(9), r.randrange(5)) for _ in range(20)})
    every = lambda: [sorted(map(str, f.collect())) for f in (g.differences(n), g.all_mtps(n), g.siar(n), g.measured(g.siatec(n), n))]
    whole = every()
    monkeypatch.setattr(g, "BLOCK", 16)
    assert every() == whole and len(whole[0]) == sum(k * (k - 1) // 2 for k in (n.where(f"piece_id = {p}").count() for p in (0, 1)))


def test_points_in_boxes_by_merged_halves(spark, monkeypatch):
    """The counts of wide pieces, of narrow ones by their grid, and all of both by either way."""
    r = random.Random(6)
    sets = [sorted({(r.randrange(5000), r.randrange(5000)) for _ in range(90)}), sorted({(r.randrange(8), r.randrange(5)) for _ in range(25)}), [(3, 3)], sorted({(r.randrange(9), 1000 * k) for k in range(64)})]
    boxes = []
    for k, s in enumerate(sets):
        for _ in range(40):
            (a, b), (c, d) = r.choice(s), r.choice(s)
            boxes.append((k, len(boxes), min(a, c), max(a, c), min(b, d), max(b, d)))
    want = {i: sum(a <= x <= b and c <= y <= d for x, y in sets[k]) for k, i, a, b, c, d in boxes}
    df, n = spark.createDataFrame(boxes, "piece_id long, id long, o0 long, o1 long, p0 long, p1 long"), points(spark, *sets)
    assert [x.piece_id for x in g.wide_pieces(n).collect()] == [0]
    for grid in (64, 0, 10**9):
        monkeypatch.setattr(g, "GRID", grid)
        assert {x.id: x.in_box for x in g.in_boxes(df, n, ["piece_id", "id"]).collect()} == want
