"""Near-duplicate documents by min-max hashing.

Every permutation gives two signature values, the minimum and the maximum, so half the hash evaluations of plain
MinHash fill a signature. Bands of it bucket the documents; links are confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernels as K
from ._graph import components
from ._store import Store, small

PERMUTATIONS = 126
#: The chance that a pair at the threshold shares no band.
MISS = 5e-6
#: Bounds of a block in the last round.
BLOCK_ROWS, BLOCK_BYTES = 256, 8 << 20


def banding(threshold: float, values: int = 2 * PERMUTATIONS, miss: float = MISS) -> tuple[int, int]:
    """(rows, bands) with the most rows that miss a pair at the threshold with at most this chance."""
    return max(((r, values // r) for r in range(1, 17) if (1 - threshold**r) ** (values // r) <= miss), default=(1, values))


def signature(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum and maximum of a * x + b modulo 2**64 for each permutation: 2 * len(a) values."""
    low, high = np.full(len(a), ~np.uint64(0)), np.zeros(len(a), np.uint64)
    for i in range(0, len(x), 2048):
        y = x[None, i : i + 2048] * a[:, None] + b[:, None]
        low, high = np.minimum(low, y.min(1)), np.maximum(high, y.max(1))
    return np.stack([low, high], 1).ravel()


def _shingle_sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    data, offsets = K.buffers(batch.column("text"))
    for i, j in K.chunks(offsets):
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        start, end, at = K.words(part, off)
        h, to = K.shingles(K.word_hashes(part, start, end, True), at, size)
        for d in range(j - i):
            x = np.sort(h[to[d] : to[d + 1]])
            yield i + d, x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _block_links(t: pa.Table, percent: int) -> pa.Table:
    """Links between the components that two blocks of a bucket hold, by products of their incidence matrices."""
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["hashes"].combine_chunks()] if t.num_rows else []
    size = np.array([len(x) for x in sets])
    shingle, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(sets)), size), n > 1
    row, column = row[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for c in range(0, int(shared.sum()), 1 << 14):
        some = (column >= c) & (column < c + (1 << 14))
        m = np.zeros((len(sets), 1 << 14), np.float32)
        m[row[some], column[some] - c] = 1
        both += m @ m.T
    ids, component = t["id"].to_numpy(), t["component"].to_numpy()
    link = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    x, y = np.nonzero(np.triu(link & (component[:, None] != component[None, :]), 1))
    return pa.table({"a": np.minimum(ids[x], ids[y]), "b": np.maximum(ids[x], ids[y])})


def near_duplicates(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_shingles, component_id (the smallest id reachable by links) and kept (it is that id).

    Documents link when their sets of `shingle`-word shingles (words split at ASCII space, A-Z lower-cased; a shorter
    text is one shingle) have a Jaccard similarity of at least `threshold`, which is read with two decimals and tested
    exactly in integers. Documents with equal sets are one class throughout, so copies never make pairs.

    Candidates of a class are those that share a band with it. Links only matter where they join components, so pairs
    are tested in rounds: first each class against the least of its buckets, then against the member of the bucket that
    has most links so far, while that joins any, and in the end every pair of a bucket that still lies in two
    components, which only happens among texts that resemble but don't link. No pair of a bucket is left out.

    Null or blank texts have no shingles and link with nothing. Rows with a null id are not documents and give no row.
    Rows that repeat an id give a row each. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    store = Store(spark)
    percent = round(100 * threshold)
    rows, bands = banding(threshold)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = K.constants(11, PERMUTATIONS), K.constants(12, PERMUTATIONS)
        weights = K.constants(13, rows)
        order = np.random.default_rng(5).permutation(2 * PERMUTATIONS)[: rows * bands]  # a band mixes minima and maxima
        salt = K.constants(14, bands)
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            digest = np.zeros((batch.num_rows, 2), np.uint64)
            buckets = np.zeros((batch.num_rows, bands), np.uint64)
            for d, x in _shingle_sets(batch, shingle):
                n[d] = len(x)
                if len(x):
                    digest[d] = K.mix(x).sum(), K.mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()
                    buckets[d] = K.mix((signature(x, a, b)[order].reshape(bands, rows) * weights).sum(1) + salt)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(digest[:, 0].view(np.int64)), pa.array(digest[:, 1].view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * bands), pa.array(buckets.ravel().view(np.int64)))],
                names=["doc_id", "n_shingles", "d0", "d1", "bands"],
            )

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [x.tobytes() for _, x in _shingle_sets(batch, shingle)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["id", "hashes"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = 0
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    if len(x) > len(y):
                        x, y = y, x
                    at = np.searchsorted(y, x)
                    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    signed = store.save(docs.mapInArrow(sign, "doc_id long, n_shingles long, d0 long, d1 long, bands array<long>"))
    classes = signed.where("n_shingles > 0").groupBy("d0", "d1").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    classes = store.save(classes)
    buckets = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("rep").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = store.save(buckets.join(store.save(shared).hint("merge"), "bucket"))  # written first, so that a large bucket can be split

    ids = store.save(shared.select(F.col("rep").alias("doc_id")).distinct())
    n_ids = ids.count()
    if n_ids == 0:
        return _result(signed, classes, None)
    hashes = store.save(docs.join(small(ids, n_ids, 40), "doc_id", "left_semi").mapInArrow(sets, "id long, hashes binary"))

    def test(pairs: DataFrame) -> DataFrame:
        x = hashes.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
        y = hashes.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
        return pairs.join(y.hint("merge"), "b").join(x.hint("merge"), "a").mapInArrow(confirm, "a long, b long")

    tested = store.save(shared.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct())
    links = store.save(test(tested))
    while True:
        label = components(store, links)
        degree = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("degree"))
        known = label.withColumnRenamed("id", "rep").join(degree, "rep", "left")
        members = shared.join(known.hint("merge"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component"), F.coalesce("degree", F.lit(0)).alias("degree"))
        members = store.save(members)
        split = members.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.max(F.struct("degree", "rep", "component")).alias("hub")).where("c0 <> c1").select("bucket", "hub")
        members = store.save(members.join(split.hint("merge"), "bucket"))
        pairs = members.where("component <> hub.component").select(F.least("hub.rep", "rep").alias("a"), F.greatest("hub.rep", "rep").alias("b")).distinct()
        pairs = store.save(pairs.join(tested.hint("merge"), ["a", "b"], "left_anti"))
        found = store.save(test(pairs)) if pairs.count() else None
        if found is None or not found.take(1):
            break
        tested, links = store.save(tested.unionByName(pairs)), store.save(links.unionByName(found))

    if members.take(1):
        sized = members.select("bucket", F.col("rep").alias("id"), "component").join(hashes.hint("merge"), "id")
        parts = sized.groupBy("bucket").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum(F.length("hashes")) / BLOCK_BYTES)).cast("int").alias("parts"))
        dealt = sized.join(parts.hint("merge"), "bucket").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        dealt = dealt.select("bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "component", "hashes")
        rest = store.save(dealt.groupBy("bucket", "i", "j").applyInArrow(lambda t: _block_links(t, percent), "a long, b long"))
        if rest.take(1):
            label = components(store, links.unionByName(rest))
    return _result(signed, classes, label)


def _result(signed: DataFrame, classes: DataFrame, label: DataFrame | None) -> DataFrame:
    rep = F.col("rep")
    out = signed.select("doc_id", "n_shingles", "d0", "d1").join(classes.select("d0", "d1", "rep").hint("merge"), ["d0", "d1"], "left")
    if label is not None:
        out = out.join(label.withColumnRenamed("id", "rep").hint("merge"), "rep", "left")
        rep = F.coalesce("component", "rep")
    out = out.select("doc_id", "n_shingles", F.coalesce(F.when(F.col("n_shingles") > 0, rep), F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
