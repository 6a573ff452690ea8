"""Benchmark decontamination by greedy string tiling.

Test items and documents are joined on their seeds (hashes of `least` words); for every pair that shares one, the longest
matches are marked one after the other, never the same words twice (running Karp-Rabin), and the share of the item that
the tiles cover is compared with a threshold, so that reordered passages are found too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _kernels as K
from ._store import Store, lean

#: Words of the shortest tile, and the share of an item's words that makes a document contaminated.
LEAST, COVERAGE = 5, 0.5
#: Bytes of benchmark text that are broadcast to every task; a larger benchmark is joined by shuffles, with the same result.
BROADCAST_BYTES = 16 << 20


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in doc, start in item, length) of two sequences of word hashes: the longest match of unmarked
    words is marked, again and again, until none of `least` words is left. Ties go to the first place in doc, then in item.

    The longest length is found by halving: whether a match of some length is left is seen from rolling hashes of both sides' unmarked
    stretches. All matches of that length are then marked in one scan. Work and memory are linear in both lengths for each try.
    """
    out: list[tuple[int, int, int]] = []
    free = [np.ones(len(doc), bool), np.ones(len(item), bool)]
    pre = [K.prefix(doc, "word"), K.prefix(item, "word")]

    def stretches(side: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of n unmarked words, and hashes of these words."""
        f = np.concatenate([[0], np.cumsum(~free[side])])
        s = np.flatnonzero(f[n:] == f[:-n]) if n < len(f) else np.zeros(0, np.int64)
        return s, K.ranges(pre[side], s, s + n, "word")

    def matches(n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in doc that match somewhere, and item places by content, in order."""
        (p, x), (q, y) = stretches(0, n), stretches(1, n)
        return p[np.isin(x, y)], q

    top = min(len(doc), len(item))
    while True:
        low, high, p, q = least - 1, top, None, None
        while low < high:
            mid = (low + high + 1) // 2
            at = matches(mid)
            if len(at[0]):
                low, (p, q) = mid, at
            else:
                high = mid - 1
        if p is None:
            return out
        n = top = low
        where: dict[bytes, list[int]] = {}
        for b in q.tolist():
            where.setdefault(item[b : b + n].tobytes(), []).append(b)
        found, doc_end, item_used = False, 0, free[1]
        for a in p.tolist():
            if a < doc_end:
                continue
            rest = where.get(doc[a : a + n].tobytes(), [])  # the words themselves, not their rolling hash
            while rest and not item_used[rest[0] : rest[0] + n].all():
                rest.pop(0)
            if rest:
                b = rest[0]
                out.append((a, b, n))
                free[0][a : a + n] = item_used[b : b + n] = False
                doc_end, found = a + n, True
        if not found:  # only hashes were equal
            top = n - 1


def seeds_of(words: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of every run of `least` words of texts that have as many."""
    h, to = K.shingles(words, at, least)
    text = np.repeat(np.arange(len(at) - 1), np.diff(to))
    ok = (np.diff(at) >= least)[text] if len(text) else np.zeros(0, bool)
    place = np.arange(len(h)) - np.repeat(to[:-1], np.diff(to))
    return text[ok], place[ok], h[ok]


def needed(words: np.ndarray, least: int, coverage: float) -> np.ndarray:
    """Seeds that a document must share of an item of so many words, if its tiles cover the share: each covers `least` at most."""
    return np.maximum(1, np.ceil(np.round(coverage * words / least, 9))).astype(np.int64)


def covered_by(doc: np.ndarray, item: np.ndarray, least: int) -> tuple[float, int]:
    """(share of the item's words that tiles cover, number of tiles)."""
    found = tiles(doc, item, least)
    return sum(n for _, _, n in found) / max(len(item), 1), len(found)


class Items:
    """A benchmark of bounded size: words and seeds of its items."""

    def __init__(self, ids: list[int], texts: pa.Array, least: int):
        data, offsets = K.buffers(texts)
        start, end, self.at = K.words(data, offsets)
        self.ids, self.words = np.array(ids, np.int64), K.word_hashes(data, start, end, True)
        item, place, h = seeds_of(self.words, self.at, least)
        o = np.lexsort((place, item, h))
        self.item, self.place, self.seeds = item[o], place[o], h[o]

    def text(self, k: int) -> np.ndarray:
        return self.words[self.at[k] : self.at[k + 1]]


def contamination(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """All columns of docs and item_id (of the item whose words the document's tiles cover most, if that is at least
    `coverage`; else null), coverage, n_tiles (0 without an item) and contaminated (there is an item).

    Words are split at ASCII space, A-Z lower-cased. Items of fewer than `least` words, null items and items with a null
    id can't be covered. Null and empty documents are not contaminated. Ties of coverage go to the smallest item id; items that repeat an id are
    items of their own. Rows with null ids and rows that repeat an id are judged like others. Columns of docs with the new
    names are replaced; an empty table gives an empty result.
    """
    lean(docs.sparkSession)
    docs = docs.drop("item_id", "coverage", "n_tiles", "contaminated")
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0))).first()[0]
    return (_looked_up if size <= BROADCAST_BYTES else _joined)(docs, items, least, coverage, text_col)


def _looked_up(docs: DataFrame, items: DataFrame, least: int, coverage: float, text_col: str) -> DataFrame:
    """The seed join with a benchmark of bounded size, which every task holds."""
    names = docs.columns
    rows = sorted(items.collect())
    shared = docs.sparkSession.sparkContext.broadcast(Items([r.item for r in rows], pa.array([r.text for r in rows], pa.string()), least))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        size = np.diff(bench.at)
        need = needed(size, least, coverage)
        for batch in batches:
            data, offsets = K.buffers(batch.column(names.index(text_col)))
            best: list[tuple] = [(None, 0.0, 0)] * batch.num_rows
            for i, j in K.chunks(offsets) if len(bench.seeds) else ():
                part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                start, end, at = K.words(part, off)
                words = K.word_hashes(part, start, end, True)
                doc, place, h = seeds_of(words, at, least)
                low = np.searchsorted(bench.seeds, h)
                hit = np.flatnonzero(bench.seeds[np.minimum(low, len(bench.seeds) - 1)] == h)
                if not len(hit):
                    continue
                known = np.unique(np.stack([doc[hit], low[hit]], 1), axis=0)  # a seed once for each document
                n = np.searchsorted(bench.seeds, bench.seeds[known[:, 1]], "right") - known[:, 1]
                k = np.repeat(known[:, 1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                pair, seeds = np.unique(np.repeat(known[:, 0], n) * len(size) + bench.item[k], return_counts=True)
                for p, m in zip(pair.tolist(), seeds.tolist()):
                    d, it = divmod(p, len(size))
                    top = min(1.0, m * least / size[it])
                    if m < need[it] or top < best[i + d][1]:
                        continue  # can't reach the threshold, or what was found
                    of = hit[doc[hit] == d]
                    own = np.zeros(at[d + 1] - at[d], bool)
                    for s in range(least):
                        own[place[of] + s] = True
                    share, n_tiles = covered_by(np.where(own, words[at[d] : at[d + 1]], np.uint64(0)), bench.text(it), least)
                    if share >= coverage and (-share, bench.ids[it]) < (-best[i + d][1], best[i + d][0] or 0):
                        best[i + d] = int(bench.ids[it]), share, n_tiles
            x, y, z = zip(*best) if best else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x, pa.int64()), pa.array(y, pa.float64()), pa.array(z, pa.int64()), pa.array([c is not None for c in x], pa.bool_())], names=[*names, "item_id", "coverage", "n_tiles", "contaminated"])

    kinds = ", ".join(f"`{c}` {k}" for c, k in docs.dtypes)
    return docs.mapInArrow(match, f"{kinds}, item_id long, coverage double, n_tiles long, contaminated boolean")


def _joined(docs: DataFrame, items: DataFrame, least: int, coverage: float, text_col: str) -> DataFrame:
    """The seed join with a benchmark of any size, by shuffles.

    A document whose tiles cover enough of an item shares at least `needed` of its P seeds, so it has one of any
    P - needed + 1: those that fewest documents have are joined, which leaves out phrases that most documents share.
    """
    store = Store(docs.sparkSession)
    rows = store.save(docs.withColumn("_row", F.monotonically_increasing_id()))
    tests = store.save(items.withColumn("k", F.monotonically_increasing_id()))

    def sown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.buffers(batch.column("text"))
            ids = batch.column("k").to_numpy()
            for i, j in K.chunks(offsets):
                part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                start, end, at = K.words(part, off)
                text, _, h = seeds_of(K.word_hashes(part, start, end, True), at, least)
                once = np.unique(np.stack([text.astype(np.uint64), h], 1), axis=0)
                text = once[:, 0].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][text]), pa.array(np.ascontiguousarray(once[:, 1]).view(np.int64)), pa.array(np.diff(at)[text].astype(np.int64))], names=["k", "seed", "words"])

    seeds = store.save(tests.select("k", "text").mapInArrow(sown, "k long, seed long, words long"))
    every = store.save(rows.select(F.col("_row").alias("k"), F.col(text_col).alias("text")).mapInArrow(sown, "k long, seed long, words long").select(F.col("k").alias("_row"), "seed"))
    counts = store.save(every.join(seeds.select("seed").distinct().hint("merge"), "seed", "left_semi").groupBy("seed").agg(F.count(F.lit(1)).alias("n")))
    n = F.coalesce("n", F.lit(0))
    rare = Window.partitionBy("k").orderBy(n, "seed")
    places = F.greatest(F.col("words") - least + 1, F.lit(1))
    need = F.greatest(F.lit(1), F.ceil(F.round(coverage * F.col("words") / least, 9)))
    chosen = store.save(seeds.join(counts.hint("merge"), "seed", "left").withColumn("rank", F.row_number().over(rare)).where(F.col("rank") <= places - need + 1).where(n > 0).select("k", "seed"))
    pairs = store.save(every.join(chosen.hint("merge"), "seed").select("_row", "k").distinct())
    sides = pairs.join(tests.select("k", "item", F.col("text").alias("test")).hint("merge"), "k").join(rows.select("_row", F.col(text_col).alias("doc")).hint("merge"), "_row")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashed(text: str) -> np.ndarray:
            data, offsets = K.buffers(pa.array([text], pa.string()))
            start, end, _ = K.words(data, offsets)
            return K.word_hashes(data, start, end, True)

        for batch in batches:
            out = [covered_by(hashed(d.as_py()), hashed(t.as_py()), least) for d, t in zip(batch.column("doc"), batch.column("test"))]
            share, n_tiles = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("item"), pa.array(share, pa.float64()), pa.array(n_tiles, pa.int64())], names=["_row", "item", "share", "n"])

    judged = sides.select("_row", "item", "doc", "test").mapInArrow(judge, "_row long, item long, share double, n long").where(F.col("share") >= coverage)
    best = store.save(judged.groupBy("_row").agg(F.min(F.struct((-F.col("share")).alias("s"), "item", "n")).alias("best")))
    out = rows.join(best.hint("merge"), "_row", "left")
    columns = [F.col("best.item").alias("item_id"), F.coalesce(-F.col("best.s"), F.lit(0.0)).alias("coverage"), F.coalesce("best.n", F.lit(0)).cast("long").alias("n_tiles"), F.col("best").isNotNull().alias("contaminated")]
    store.drop(tests, seeds, every, counts, chosen, pairs)
    return out.select(*docs.columns, *columns)
