"""Batches, variants, masks, losses and the fit, against plain Python."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cantus.operators import training as t


def labelled(seed=0):
    r = random.Random(seed)
    rows = [(k, r.choice([1, 1, 1, 2, 2, 3])) for k in range(300)] + [(900, 50), (901, None), (902, 60), (903, 60)]
    return rows, [x for _, x in rows]


@pytest.mark.parametrize("ranked,digits", [(1 << 16, 3), (3, 1), (1, 3)])
def test_batches_hold_at_least_two_of_a_label(spark, ranked, digits):
    rows, labels = labelled()
    df = spark.createDataFrame([(i, x, "b") for i, x in rows], "id long, label long, batch string")
    got = t.contrastive_batches(df, 16, ranked=ranked, digits=digits).collect()
    assert sorted(r.id for r in got) == sorted(i for i, _ in rows)
    batches = defaultdict(list)
    for r in got:
        if r.batch is None:
            assert r.id in (900, 901)
        else:
            batches[r.batch].append(r)
    assert sorted(batches) == list(range(len(batches)))
    for k, b in batches.items():
        assert min(Counter(r.label for r in b).values()) >= 2
        assert sorted(r.place for r in b) == list(range(len(b)))
        if ranked > 100:  # eight pairs, of which few have a third row
            assert 16 <= len(b) <= 20 or k == max(batches)
    again = t.contrastive_batches(df.repartition(7, "label"), 16, ranked=ranked, digits=digits).collect()
    assert {(r.id, r.batch, r.place) for r in again} == {(r.id, r.batch, r.place) for r in got}
    assert t.contrastive_batches(df.where("false"), 16).collect() == []


def test_variants(spark):
    steps = spark.createDataFrame([(p, s, i, 1, 0.0) for p in range(3) for s in range(60) for i in range(1 + s % 9)], "piece_id long, seg long, i long, d_pitch long, d_time double")
    got = t.augmented(steps, 2, (0.5, 2.0), 0.0, 0.4).collect()
    by = defaultdict(list)
    for r in got:
        by[r.variant, r.piece_id, r.seg].append(r.d_time)
    assert len(by) == 2 * 3 * 60  # no sequence runs empty
    assert all(len(set(v)) == 1 and math.log(0.5) < v[0] < math.log(2) for v in by.values()) and len({v[0] for v in by.values()}) == len(by)
    n = steps.count()
    assert 0.55 < len(got) / (2 * n) < 0.7
    noise = np.array([r.d_time for r in t.augmented(steps, 8, jitter=0.3).collect()])
    assert abs(noise.mean()) < 0.02 and abs(noise.std() - 0.3) < 0.02 and len(noise) == 8 * n


@pytest.mark.parametrize("length,share", [(512, 0.15), (64, 0.15), (4, 0.5)])
def test_masks_are_exact_in_every_chunk(spark, length, share):
    more = min(5, length - 1)
    words = spark.createDataFrame([(p, k // length, k % length, 0, 3, 40, 7) for p in range(3) for k in range(length + more)], "piece_id long, chunk long, pos long, t_bar int, t_position int, t_pitch int, t_duration int")
    rows = t.places(words, length)
    got = t.masked(rows, share, length).collect()
    n = round(length * share)
    a, b = round(n * 0.8), round(n * 0.1)
    plans = defaultdict(Counter)
    for r in got:
        plans[r.piece_id, r.chunk][r.plan] += 1
        fields, was = (r.m_bar, r.m_position, r.m_pitch, r.m_duration), (r.t_bar, r.t_position, r.t_pitch, r.t_duration)
        assert was == ((0, 3, 40, 7) if r.chunk == 0 or r.pos < more else (2, 16, 86, 64))
        assert fields == ((3, 17, 87, 65) if r.plan == "mask" else was) or r.plan == "random" and all(x < s for x, s in zip(fields, t.SIZES))
    assert all({k: v for k, v in p.items() if k} == {k: v for k, v in (("mask", a), ("random", b), ("keep", n - a - b)) if v} and p.total() == length for p in plans.values()) and len(plans) == 6
    again = t.masked(rows.repartition(5, "pos"), share, length).select("piece_id", "chunk", "pos", "plan").collect()
    assert {tuple(r) for r in again} == {(r.piece_id, r.chunk, r.pos, r.plan) for r in got}
    if length == 512:
        places = Counter(r.pos for r in got if r.plan)
        assert len(places) > 200  # chunks are planned differently
        assert "Exchange" not in t.masked(words, share, length)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        t.masked(words, length=100)


def test_token_loss(spark):
    r = random.Random(1)
    rows = [(k % 3, *(r.uniform(-400, 400) if k % 5 else r.uniform(-2, 2) for _ in range(3)), r.choice([0, 1, 2, None]), r.choice([True, False, None])) for k in range(60)] + [(9, 0.0, 0.0, 0.0, None, True)]
    weights = (1.0, 2.0, 0.5)
    want = defaultdict(list)
    for g, *s, y, m in rows:
        if y is not None and m:
            want[g].append(weights[y] * (math.log(sum(math.exp(x - max(s)) for x in s)) + max(s) - s[y]))
    df = spark.createDataFrame(rows, "g int, a double, b double, c double, y int, m boolean")
    got = {x.g: (x.n, x.loss) for x in t.token_loss(df, ["a", "b", "c"], F.col("y"), weights, F.col("m"), ["g"]).collect()}
    assert got.pop(9) == (0, None)
    assert {g: n for g, (n, _) in got.items()} == {g: len(v) for g, v in want.items()}
    assert all(v == pytest.approx(sum(want[g]) / len(want[g])) for g, (_, v) in got.items())
    assert t.token_loss(df.where("false"), ["a", "b", "c"], F.col("y"), weights).first().loss is None


@pytest.mark.parametrize("temperature", [0.5, 0.001])
def test_contrastive_loss_of_any_blocks(spark, temperature):
    r = np.random.default_rng(0)
    vectors = r.normal(size=(60, 5))
    vectors[7] = 0
    vectors[8] = vectors[9]
    labels = [*(int(x) for x in r.integers(0, 8, 58)), 77, 78]
    rows = [(k % 2, k, labels[k], [float(x) for x in vectors[k]]) for k in range(60)] + [(0, 99, None, [1.0] * 5), (1, 98, 3, None), (5, 97, 3, [1.0] * 5)]
    df = spark.createDataFrame(rows, "batch int, id long, label long, vector array<double>")
    want = {}
    for b in (0, 1):
        own = [k for k in range(60) if k % 2 == b]
        norm = np.linalg.norm(vectors[own], axis=1, keepdims=True)
        z = np.where(norm < 1e-9, 0, vectors[own] / np.maximum(norm, 1e-9))
        s = z @ z.T / temperature
        losses = []
        for i, k in enumerate(own):
            others = [j for j in range(len(own)) if j != i]
            same = [j for j in others if labels[own[j]] == labels[k]]
            if same:
                top = max(s[i, others])
                losses.append(top + math.log(sum(math.exp(x - top) for x in s[i, others]) + 1e-9 * math.exp(-min(top, 700))) - np.mean(s[i, same]))
        want[b] = (len(own), len(losses), np.mean(losses))
    for block in (1000, 7, 1):
        got = {x.batch: (x.n, x.n_valid, x.loss) for x in t.contrastive_loss(df, temperature, block=block).collect()}
        assert got.pop(5) == (1, 0, None)
        assert {b: v[:2] for b, v in got.items()} == {b: v[:2] for b, v in want.items()}
        assert all(got[b][2] == pytest.approx(want[b][2], rel=1e-9) for b in want)
    whole = t.contrastive_loss(df.where("id < 60"), temperature, batch=None, block=16).first()
    assert (whole.n, whole.n_valid) == (60, sum(labels.count(x) > 1 for x in labels))


def words(seed, n=800):
    r = random.Random(seed)
    out = []
    for k in range(n):
        bar, pos, pitch, dur = r.randrange(2), r.randrange(16), r.randrange(86), r.randrange(64)
        out.append((k % 5, 1 if pitch > 60 else 2 if dur > 50 else 3, bar, pos, pitch, dur))
    return out


def one_process(rows, rounds, rate, decay, weights):
    x = np.array([[*(v / n for v, n in zip(r[2:], t.SIZES)), 1.0] for r in rows])
    fold, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    cost = np.array(weights)[y]
    out = []
    for k in range(5):
        w, f1s, ws = np.zeros((4, 5)), [], []
        for _ in range(rounds):
            s = x @ w.T
            valid = fold == (k + 1) % 5
            a, b = np.isin(s.argmax(1), (1, 2))[valid], np.isin(y, (1, 2))[valid]
            f1s.append(2 * (a & b).sum() / max((2 * (a & b).sum() + (a != b).sum()), 1))
            ws.append(w)
            train = (fold != k) & ~valid
            p = np.exp(s) / np.exp(s).sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            w = w - rate * ((p[train] * cost[train, None]).T @ x[train] / cost[train].sum() + decay * w)
        best = int(np.argmax(f1s))
        out.append((ws[best], f1s, best))
    return out


def test_the_fit_equals_that_of_one_process_on_any_partitions(spark):
    rows = words(0)
    cost = (1.0, 2.0, 1.0, 1.0)
    want = one_process(rows, 30, 3.0, 0.001, cost)
    for parts in (1, 7):
        df = spark.createDataFrame([*rows, (None, 1, 0, 0, 0, 0), (0, None, 0, 0, 0, 0)], "fold int, label int, t_bar int, t_position int, t_pitch int, t_duration int").repartition(parts)
        fits = t.fit(df, rounds=30, patience=30, rate=3.0, decay=0.001, weights=cost)
        for f, (w, f1s, best) in zip(fits, want):
            got = np.column_stack([np.array(f.scorer.weights) * t.SIZES, f.scorer.bias])
            assert np.abs(got - w).max() < 1e-9 and f.best == best and f.f1 == pytest.approx(f1s)
    scores = {r.fold: r for r in t.fold_f1(df, fits).collect()}
    for k, f in enumerate(fits):
        own = [r for r in rows if r[0] == k]
        found = f.scorer.score(np.array([r[2:] for r in own], float)).argmax(1)
        pairs = Counter((int(p) in (1, 2), r[1] in (1, 2)) for p, r in zip(found, own))
        assert (scores[k].tp, scores[k].fp, scores[k].fn) == (pairs[True, True], pairs[True, False], pairs[False, True]) and scores[k].f1 > 0.6


def test_rounds_end_when_validation_gets_no_better(spark):
    df = spark.createDataFrame(words(1, 200), "fold int, label int, t_bar int, t_position int, t_pitch int, t_duration int")
    fits = t.fit(df, rounds=50, patience=2, rate=0.0)
    assert all(len(f.f1) == 3 and f.best == 0 for f in fits)
    assert [f.f1 for f in t.fit(df.where("false"))] == [()] * 5
