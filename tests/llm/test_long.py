"""Texts of more than one chunk, and odd inputs that the other tests don't hold."""

import random

import numpy as np
import pytest

from cantus.llm import _kernels as K
from cantus.llm import ordinal, packing, pitman_yor, tiling
from cantus.llm.minhash import near_duplicates
from cantus.llm.suffix import drop_repeated_bytes
from cantus.llm.superkmer import drop_repeated_windows
from test_dedup import brute_words, jaccard_components


@pytest.fixture(scope="module")
def long_rows():
    r = random.Random(0)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(5000)]
    w = [r.choice(vocabulary) for _ in range(110_000)]
    again = list(w)
    again[5000:5003] = ["other", "words", "here"]
    own = [r.choice(vocabulary) for _ in range(300)]
    rows = [(1, " ".join(w)), (2, "short"), (3, " ".join(again)), (4, " ".join(own + w[-200:]))]
    assert len(rows[0][1]) > K.CHUNK
    return rows


def test_long_texts_in_dedup(spark, long_rows):
    df = spark.createDataFrame(long_rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, 0.8).collect()}
    assert got == jaccard_components(long_rows, 80)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_words) for r in drop_repeated_windows(df, 20).collect()}
    assert got == brute_words(long_rows)
    kept = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in drop_repeated_bytes(df, 200, keep_first=True).collect()}
    assert kept[1] == (len(long_rows[0][1]), 0, 0) and kept[2] == (5, 0, 0)
    assert kept[3][2] == 2 and kept[3][0] - kept[3][1] < 600 and kept[4][2] == 1


def test_long_texts_in_models(spark, long_rows):
    df = spark.createDataFrame(long_rows, "doc_id long, text string")
    item = " ".join(long_rows[0][1].split()[-60:-20])
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    found = {r.doc_id: (r.item_id, r.coverage) for r in tiling.contamination(df, bench).collect()}
    assert found == {1: (7, 1.0), 2: (None, 0.0), 3: (7, 1.0), 4: (7, 1.0)}
    scored = {r.doc_id: r.n_tokens for r in pitman_yor.score(df, sweeps=1).collect()}
    assert scored == {k: len(t.split()) + 1 for k, t in long_rows}
    model = ordinal.Model(np.ones(1 << ordinal.BITS, np.float32) * 1e-6, np.array([0.0, 1.0]))
    assert sorted(r.doc_id for r in ordinal.severity(df, model).collect()) == [1, 2, 3, 4]


def test_repeated_ids_and_no_labels(spark):
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (1, "x y"), (None, "a b c d e f g h")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(5, "a b c d e f g h")], "item_id long, text string")
    assert sorted(r.contaminated for r in tiling.contamination(df, bench).collect()) == [False, True, True, True]
    model = ordinal.fit(df, spark.createDataFrame([], "doc_id long, grade int"))
    assert [r.toxic for r in ordinal.severity(df, model).collect()] == [False] * 4
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.pack(df, path).count() == 3 and packing.pack(df, path, null_ids=True).count() == 4
