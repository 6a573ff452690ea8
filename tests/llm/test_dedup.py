"""Near-dedup, substring dedup and embeddings against brute force, on small tables that hold every odd case."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cantus.llm import repeats
from cantus.llm.descent import embedding_links
from cantus.llm.minhash import banding, near_duplicates, signature
from cantus.llm.suffix import drop_repeated_bytes, longest_previous
from cantus.llm.superkmer import drop_repeated_windows

ODD = "doc_id long, text string, component_id long, spans string, n_words long"


def corpus(seed=0, n=40):
    """Random texts, copies, near copies, shared passages, odd texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(1, 6))).replace(" ", "") or "x"
    make = lambda k: [word() for _ in range(k)]
    passage = make(60)
    texts = []
    for k in range(n):
        w = make(r.randint(5, 150))
        if k % 4 == 1:
            at = r.randrange(len(w))
            w[at:at] = passage
        texts.append(" ".join(w))
    for k in range(0, n, 5):
        w = texts[k].split(" ")
        w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [texts[3], texts[3], texts[3].upper(), texts[7].replace(" ", "\n"), None, "", " \t\n", "one two", "ONE two", "a " * 300, "a " * 300, "x" * 5000, " ".join(make(3000)), "\u00a0 nbsp word"]
    return [(10 * k + 3, t) for k, t in enumerate(texts)]


def frame(spark, rows):
    """With columns whose names clash with those that operators make, and a row without an id."""
    return spark.createDataFrame([(i, t, -1, "s", None) for i, t in rows] + [(None, "no id", -1, "s", 7)], ODD).repartition(3)


def words(t, lower=False):
    b = (t or "").encode()
    return tuple((b.lower() if lower else b).split())


def jaccard_components(rows, percent):
    sets = {}
    for i, t in rows:
        w = words(t, True)
        sets[i] = {w[k : k + 5] for k in range(len(w) - 4)} if len(w) >= 5 else {w} if w else set()
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {i: (len(s), label[i], label[i] == i) for i, s in sets.items()}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent):
    rows = corpus()
    got = near_duplicates(frame(spark, rows), percent / 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == jaccard_components(rows, percent) and len(got) == len(rows)


def test_chains_and_stars_are_joined_through_unlinked_members(spark):
    """A hub to which all link, none of which link to each other, and its smallest id isn't the hub's."""
    r = random.Random(2)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(40):
        w = list(base)
        for at in r.sample(range(0, 300, 30), 4):
            w[at + r.randrange(20)] = f"new{k}_{at}"
        rows.append((k, " ".join(w)))
    rows.append((100, " ".join(base)))
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near_duplicates(frame(spark, rows), 0.85).collect()}
    assert got == jaccard_components(rows, 85)


def test_signature_estimates_without_bias():
    r = np.random.default_rng(0)
    a, b = r.integers(1, 1 << 63, 126).astype(np.uint64) | np.uint64(1), r.integers(0, 1 << 63, 126).astype(np.uint64)
    from cantus.llm._kernels import mix

    x = mix(np.arange(1000, dtype=np.uint64))
    same = [(signature(x[:800], a, b) == signature(x[k : 800 + k], a, b)).mean() - (800 - k) / (800 + k) for k in (0, 50, 100, 200)]
    assert same[0] == 0 and max(map(abs, same)) < 0.12
    rows, bands = banding(0.85)
    assert (1 - 0.85**rows) ** bands <= 5e-6 and rows * bands <= 252


def brute_words(rows, n=20):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if w[k : k + n] in seen:
                gone[k : k + n] = [True] * n
            seen.add(w[k : k + n])
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


@pytest.mark.parametrize("hot", [3000, 2])
def test_repeated_windows(spark, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = corpus(1)
    got = drop_repeated_windows(frame(spark, rows), 20, carry=["component_id"]).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_words) for r in got} == brute_words(rows)
    kept = {r.doc_id: r.text for r in got}
    for i, t in rows:
        assert (kept[i] or "").split() == (brute_words(rows)[i][2]).split() or "\u00a0" in t
        if brute_words(rows)[i][1] == 0:
            assert kept[i] == t


def brute_bytes(rows, n, keep_first):
    c, seen, out = Counter(), set(), {}
    for _, t in rows:
        b = (t or "").encode()
        c.update(b[k : k + n] for k in range(len(b) - n + 1))
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            x = b[k : k + n]
            if (x in seen) if keep_first else c[x] > 1:
                gone[k : k + n] = b"\1" * n
            seen.add(x)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize("hot,keep_first", [(3000, False), (2, False), (3000, True), (2, True)])
def test_repeated_bytes(spark, hot, keep_first, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = corpus(2)
    got = drop_repeated_bytes(frame(spark, rows), 100, keep_first=keep_first).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == brute_bytes(rows, 100, keep_first)


def test_longest_previous_factors():
    r = np.random.default_rng(1)
    for _ in range(100):
        x = np.concatenate([r.integers(0, 3, int(r.integers(1, 50))), [99]])
        length, source = longest_previous(x)
        for i in range(len(x)):
            common = [next((k for k in range(len(x) - i) if x[j + k] != x[i + k]), len(x) - i) for j in range(i)]
            assert length[i] == max(common, default=0)
            if length[i]:
                assert (x[source[i] : source[i] + length[i]] == x[i : i + length[i]]).all() and source[i] < i


def test_embeddings(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 16))
    x[50:130] = x[50] + 0.02 * r.normal(size=(80, 16))
    x[200:203] = x[10] * [[1], [2], [1.00001]]
    x[210:230] = x[211]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] + [1.0] * 15), (1004, [None] + [1.0] * 15), (1005, [1.0] * 5), (1006, [float("inf")] * 16)]
    table = spark.createDataFrame([(i, v, "c") for i, v in rows + odd] + [(None, [1.0] * 16, "c")], "vec_id long, embedding array<double>, component_id string")
    got = {g.vec_id: (g.n_links, g.component_id, g.kept) for g in embedding_links(table, 0.95).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= 0.95
    label = np.arange(300)
    for _ in range(300):
        label = np.array([label[link[k]].min() for k in range(300)])
    want = {k: (int(link[k].sum()) - 1, int(label[k]), label[k] == k) for k in range(300)} | {i: (0, i, True) for i, _ in odd}
    assert got == want


def check_links(spark, x, threshold=0.95):
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = embedding_links(table, threshold).collect()
    got = {g.vec_id: (g.n_links, g.component_id, g.kept) for g in rows}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= threshold
    label = np.arange(len(x))
    while True:
        new = np.array([label[row].min() for row in link])
        if (new == label).all():
            break
        label = new
    assert got == {k: (int(link[k].sum()) - 1, int(label[k]), bool(label[k] == k)) for k in range(len(x))}
    return label, sum(g.n_listed for g in rows) / max(1, sum(g.n_links for g in rows)), rows[0].audit_recall


def test_adjacent_dense_groups(spark):
    """Lists full of a vector's own group must not hide the links to the group beside it."""
    r = np.random.default_rng(3)
    x = [r.normal(size=(200, 32))]
    for size in (11, 40, 40, 400):
        a, b = np.linalg.qr(r.normal(size=(32, 2)))[0].T
        for centre in (a, 0.965 * a + np.sqrt(1 - 0.965**2) * b):
            x.append(centre + 0.01 * r.normal(size=(size, 32)))
    label, _, recall = check_links(spark, np.concatenate(x))
    assert len(set(label[200:])) == 4 and recall > 0.95


def test_two_groups_whose_every_pair_is_linked(spark):
    """Thirty and thirty at 0.96 to each other: lists of ten fill with a vector's own group, longer ones hold all 59 links."""
    r = np.random.default_rng(5)
    a, b = np.linalg.qr(r.normal(size=(64, 2)))[0].T
    x = np.concatenate([c + 0.001 * r.normal(size=(30, 64)) for c in (a, 0.962 * a + np.sqrt(1 - 0.962**2) * b)])
    label, listed, recall = check_links(spark, x)
    assert set(label) == {0} and recall == 1 and listed > 0.6


def test_many_groups_of_many_sizes(spark):
    """Chains of groups, and lists that hold nearly all links of groups that fit them."""
    r = np.random.default_rng(6)
    x, centre = [r.normal(size=(1500, 24))], r.normal(size=24)
    for k in range(250):
        if k % 5 == 0:
            centre = r.normal(size=24)
        else:
            centre = centre / np.linalg.norm(centre) + 0.055 * r.normal(size=24)
        x.append(centre / np.linalg.norm(centre) + 0.02 * r.normal(size=(1 + k % 20, 24)))
    label, listed, recall = check_links(spark, np.concatenate(x))
    assert recall > 0.99 and listed > 0.9


def test_links_that_descent_misses_are_found_exhaustively(spark, monkeypatch):
    from cantus.llm import descent

    monkeypatch.setattr(descent, "ORDERS", 1)
    monkeypatch.setattr(descent, "RUN", 2)
    monkeypatch.setattr(descent, "WIDE", 100)
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 16))
    x[200:] = x[:100] + 0.05 * r.normal(size=(100, 16))
    assert len(set(check_links(spark, x)[0])) < 250


def test_empty_tables(spark):
    e = frame(spark, []).where("doc_id is not null")
    for out in (near_duplicates(e), drop_repeated_windows(e), drop_repeated_bytes(e)):
        assert out.count() == 0
    assert embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_rows_that_repeat_an_id(spark):
    rows = [(1, "a b c d e f g " * 10), (1, "a b c d e f g " * 10), (2, "z y x w v u"), (2, "other words here and there now")]
    assert near_duplicates(frame(spark, rows), 0.8).count() == 4
    assert drop_repeated_windows(frame(spark, rows)).count() == 4
    assert drop_repeated_bytes(frame(spark, rows), 50).count() == 4


def test_digest_of_kept_words(spark):
    from pyspark.sql import functions as F

    rows = corpus(3)
    got = drop_repeated_windows(frame(spark, rows)).select("doc_id", F.sha2(F.col("kept_words").cast("binary"), 256).alias("d")).collect()
    want = brute_words(rows)
    assert all(r.d == hashlib.sha256(want[r.doc_id][2].encode()).hexdigest() for r in got)


def thue_morse():
    """A word and its complement, which polynomial hashes modulo a power of two take for equal."""
    x = "a"
    while len(x) < 1024:
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomial_hashes_confuse(spark):
    x, y = thue_morse()
    common = " ".join(f"w{k}" for k in range(19))
    rows = [(1, x), (2, y), (3, f"{common} {x}"), (4, f"{common} {y}")]
    got = near_duplicates(frame(spark, rows), 0.8).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == jaccard_components(rows, 80)
    got = drop_repeated_windows(frame(spark, rows), 20).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_words) for r in got} == brute_words(rows) and all(r.n_removed == 0 for r in got)


def test_texts_of_one_id_and_columns_with_the_names_of_ours(spark):
    """Spans of one text aren't cut from another text with its id."""
    a, b = (" ".join(f"{c}{k}" for k in range(40)) for c in "xy")
    rows = [(1, a, 5, "s", 6), (1, b, 5, "s", 6), (2, f"start {a}", 5, "s", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t long, spans string, packed int")
    got = sorted((r.doc_id, r.n_removed, r.t, r.spans) for r in drop_repeated_windows(docs, 20, carry=["t", "spans"]).collect())
    assert got == [(1, 0, 5, "s"), (1, 0, 5, "s"), (2, 40, 5, "s")]
