"""Ranked lexical search of all documents for many items at once, by a dual tree.

Documents are read once and become sparse vectors over the items' terms. Batches of them form a hierarchy whose nodes hold the
largest impact of every term below them; so do the items with the largest weights. The sum of the products bounds every score
between two nodes, and a pair of nodes whose bound is below the weakest kth score of its items is dropped with all pairs below it.
What is dropped can't be among an item's best, so the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _kernels as K
from ._store import Store

#: Distinct (item, term) pairs of a block of items, which every task holds; more items are searched in several blocks.
BLOCK = 1 << 20
#: Documents and postings of a tree (whichever is reached first), children of a node of documents and of items.
LEAVES, POSTINGS, FAN, ITEM_FAN = 8192, 1 << 20, 16, 4
#: Documents (about) that are searched first: their kth scores are bounds that all tasks start from. They drop nothing by themselves.
FIRST = 20_000
#: Posting lookups that are made at once.
STEP = 1 << 20
#: Pairs of an item and a document's parent that are looked into before bounds are raised.
SLICE = 4096

#: What separates terms, among bytes (multibyte characters belong to terms).
SEPARATORS = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def term_hashes(terms: list[str]) -> np.ndarray:
    data, offsets = K.buffers(pa.array(terms, pa.string()))
    return K.word_hashes(data, offsets[:-1] - offsets[0], offsets[1:] - offsets[0], True) if terms else np.zeros(0, K.U)


class Tree:
    """Sparse rows in an order that puts like ones together, and above them levels of nodes with the coordinate maxima of `fan` children.

    Level k holds sorted keys (node * width + term), their values and where each node's keys begin.
    """

    def __init__(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, width: int, fan: int):
        self.width, self.fan = width, fan
        keys = row * width + term
        o = np.argsort(keys, kind="stable")
        self.levels = [(keys[o], value[o], np.searchsorted(keys[o], np.arange(n + 1) * width))]
        while n > 1:
            keys, value, _ = self.levels[-1]
            n = -(-n // fan)
            up = keys // width // fan * width + keys % width
            o = np.argsort(up, kind="stable")
            up = up[o]
            first = np.flatnonzero(np.diff(up, prepend=-1))
            self.levels.append((up[first], np.maximum.reduceat(value[o], first) if len(first) else value[:0], np.searchsorted(up[first], np.arange(n + 1) * width)))

    def size(self, level: int) -> int:
        return len(self.levels[level][2]) - 1

    def lifted(self, leaf: np.ndarray, fold) -> list[np.ndarray]:
        """A number for every node of every level: fold (a ufunc) over the leaves' numbers."""
        out = [leaf]
        for _ in self.levels[1:]:
            out.append(fold.reduceat(out[-1], np.arange(0, len(out[-1]), self.fan)) if len(out[-1]) else out[-1])
        return out


def like_order(ptr: np.ndarray, term: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Rows by their two weightiest coordinates, so that neighbours share what decides their scores."""
    n = len(ptr) - 1
    row = np.repeat(np.arange(n), np.diff(ptr))
    o = np.lexsort((term, -value, row))
    ranked = np.concatenate([term[o], [-1, -1]])
    count = np.diff(ptr)
    one = np.where(count > 0, ranked[np.minimum(ptr[:-1], len(ranked) - 1)], -1)
    two = np.where(count > 1, ranked[np.minimum(ptr[:-1] + 1, len(ranked) - 1)], -1)
    return np.lexsort((two, one))


def gathered(ptr: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the entries of `rows` one after the other, and for each entry which of `rows` it is of."""
    n = ptr[rows + 1] - ptr[rows]
    which = np.repeat(np.arange(len(rows)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ptr[rows], n), which


def products(items: Tree, a: int, item: np.ndarray, docs: Tree, b: int, doc: np.ndarray) -> np.ndarray:
    """Sums over terms of the products of item nodes (level a) and document nodes (level b), pair by pair, as 64-bit integers."""
    keys, weights, ptr = items.levels[a]
    in_docs, impact, _ = docs.levels[b]
    out = np.zeros(len(item), np.int64)
    edges = np.searchsorted(np.cumsum(ptr[item + 1] - ptr[item]), np.arange(0, int((ptr[item + 1] - ptr[item]).sum()) + 1, STEP))
    edges = np.unique([0, *edges.tolist(), len(item)])
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
        at, which = gathered(ptr, item[i:j])
        key = doc[i:j][which] * docs.width + keys[at] % items.width
        found = np.minimum(np.searchsorted(in_docs, key), len(in_docs) - 1)
        hit = np.flatnonzero(in_docs[found] == key)
        np.add.at(out, i + which[hit], weights[at[hit]] * impact[found[hit]])
    return out


@dataclass
class Block:
    """Items that every task holds: ids, distinct term hashes in order, and the items' tree over these terms."""

    ids: list
    hashes: np.ndarray
    weights: np.ndarray
    row: np.ndarray
    term: np.ndarray
    n_docs: int
    n_terms: int

    def __post_init__(self) -> None:
        shared = np.bincount(self.term, minlength=len(self.hashes))[self.term] > 1
        ptr = np.searchsorted(self.row, np.arange(len(self.ids) + 1))
        order = like_order(ptr, self.term, self.weights[self.term] * shared)
        place = np.argsort(order)
        self.ids = [self.ids[k] for k in order.tolist()]
        self.tree = Tree(place[self.row], self.term, self.weights[self.term], len(order), max(len(self.hashes), 1), ITEM_FAN)

    def impacts(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 100 - 90 + (90 * n * self.n_docs) // self.n_terms
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Best:
    """The k best (score, document) of every item so far, and bounds from elsewhere that a score must reach to matter."""

    def __init__(self, block: Block, k: int, bounds: list[tuple[int, int]] | None = None):
        n = len(block.ids)
        self.tree, self.k = block.tree, k
        none = np.iinfo(np.int64).max
        self.score, self.doc = np.zeros((n, k), np.int64), np.full((n, k), none)
        self.bound = np.array(bounds if bounds else [(0, none)] * n, np.int64).reshape(n, 2)
        self.raise_bounds()

    def raise_bounds(self) -> None:
        """An item's bound is the better of its kth best and the bound from elsewhere; a node's is the weakest of its items."""
        own = np.stack([self.score[:, -1], self.doc[:, -1]], 1)
        better = (own[:, 0] > self.bound[:, 0]) | (own[:, 0] == self.bound[:, 0]) & (own[:, 1] < self.bound[:, 1])
        self.bound = np.where(better[:, None], own, self.bound)
        self.least = self.tree.lifted(self.bound[:, 0], np.minimum)
        last = [self.bound[:, 1]]
        for low, high in zip(self.least, self.least[1:]):  # of the items with the weakest bound, the largest document
            at = np.where(low == np.repeat(high, self.tree.fan)[: len(low)], last[-1], np.iinfo(np.int64).min)
            last.append(np.maximum.reduceat(at, np.arange(0, len(at), self.tree.fan)))
        self.last = last

    def open(self, level: int, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Can a pair of this bound, with documents from `doc` on, still change the result?"""
        least = self.least[level][item]
        return (score > 0) & ((score > least) | (score == least) & (doc <= self.last[level][item]))

    def take(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        if not len(item):
            return
        touched = np.unique(item)
        rows = np.concatenate([np.repeat(touched, self.k), item])
        score, doc = np.concatenate([self.score[touched].ravel(), score]), np.concatenate([self.doc[touched].ravel(), doc])
        o = np.lexsort((doc, -score, rows))
        rows = rows[o]
        first = np.searchsorted(rows, touched)
        at = (first[:, None] + np.arange(self.k)).ravel()
        self.score[touched], self.doc[touched] = score[o][at].reshape(-1, self.k), doc[o][at].reshape(-1, self.k)
        self.raise_bounds()


def search(block: Block, best: Best, ids: np.ndarray, ptr: np.ndarray, term: np.ndarray, impact: np.ndarray) -> int:
    """Searches one batch of documents, given as rows of (term, impact), for all items; returns how many pairs of an item and a document were scored."""
    if not len(term) or not len(block.ids):
        return 0
    order = like_order(ptr, term, impact * block.weights[term])
    at, row = gathered(ptr, order)
    docs, items = Tree(row, term[at], impact[at], len(order), max(len(block.hashes), 1), FAN), block.tree
    ids = ids[order]
    earliest = docs.lifted(ids, np.minimum)
    a, b = len(items.levels) - 1, len(docs.levels) - 1
    item, doc = np.zeros(1, np.int64), np.zeros(1, np.int64)
    bound = products(items, a, item, docs, b, doc)

    def children(item: np.ndarray, doc: np.ndarray, down_a: int, down_b: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of children; a side that is at its leaves already stays."""
        for tree, level, side in ((items, down_a, 0), (docs, down_b, 1)):
            pair = (item, doc)[side]
            if level >= 0:
                kids = (pair[:, None] * tree.fan + np.arange(tree.fan)).ravel()
                n = tree.fan
                item, doc = (kids, np.repeat(doc, n)) if side == 0 else (np.repeat(item, n), kids)
                ok = kids < tree.size(level)
                item, doc = item[ok], doc[ok]
        return item, doc

    while a > 0 or b > 1:
        ok = best.open(a, item, bound, earliest[b][doc])
        item, doc = children(item[ok], doc[ok], a - 1, b - 1 if b > 1 else -1)
        a, b = max(a - 1, 0), b - 1 if b > 1 else b
        bound = products(items, a, item, docs, b, doc)
    scored = 0
    o = np.argsort(-bound, kind="stable")
    item, doc, bound = item[o], doc[o], bound[o]
    for i in range(0, len(item), SLICE):
        s = slice(i, i + SLICE)
        ok = best.open(0, item[s], bound[s], earliest[b][doc[s]])
        it, d = children(item[s][ok], doc[s][ok], -1, b - 1)
        score = products(items, 0, it, docs, 0, d)
        scored += len(it)
        ok = best.open(0, it, score, ids[d])
        best.take(it[ok], score[ok], ids[d[ok]])
    return scored


def vectors(docs: DataFrame, hashes: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tfs) of the documents (doc_id, text) with a term: all their terms counted, and how often they have those of `hashes` (in order)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = max(len(hashes), 1)
        for batch in batches:
            data, offsets = K.buffers(batch.column("text"))
            ids = batch.column("doc_id")
            for i, j in K.chunks(offsets):
                part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                start, end, at = K.words(part, off, SEPARATORS)
                h = K.word_hashes(part, start, end, True)
                found = np.minimum(np.searchsorted(hashes, h), width - 1)
                hit = np.flatnonzero(hashes[found] == h) if len(hashes) else np.zeros(0, np.int64)
                doc = np.searchsorted(at, hit, "right") - 1
                keys, tf = np.unique(doc * width + found[hit], return_counts=True)
                ptr = np.searchsorted(keys, np.arange(j - i + 1) * width).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ptr), pa.array(x.astype(np.int32))) for x in (keys % width, tf)]
                out = pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(np.diff(at).astype(np.int64)), *lists], names=["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(np.diff(at) > 0))

    return docs.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>")


def searched(rows: DataFrame, block: Block, k: int, bounds: list[tuple[int, int]] | None = None) -> DataFrame:
    """(item, doc_id, score, part): the k best documents of every item in each partition of vectors. item: the place in block.ids."""
    shared = rows.sparkSession.sparkContext.broadcast((block, bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, bounds = shared.value
        best = Best(block, k, bounds)
        held: list[tuple] = []

        def flush() -> None:
            if held:
                ids, n, size, term, tf = (np.concatenate(x) for x in zip(*held))
                held.clear()
                ptr = np.concatenate([[0], np.cumsum(size)])
                search(block, best, ids, ptr, term, block.impacts(tf, np.repeat(n, size)))

        for batch in batches:
            terms, tfs = batch.column("terms"), batch.column("tfs")
            edges = terms.offsets.to_numpy().astype(np.int64)
            term, tf = (x.flatten().to_numpy().astype(np.int64) for x in (terms, tfs))
            edges -= edges[0]
            ids, n = batch.column("doc_id").to_numpy(), batch.column("n").to_numpy()
            i = 0
            while i < len(ids):
                j = min(max(i + 1, int(np.searchsorted(edges, edges[i] + POSTINGS, "right")) - 1), i + LEAVES)
                held.append((ids[i:j], n[i:j], np.diff(edges[i : j + 1]), term[edges[i] : edges[j]], tf[edges[i] : edges[j]]))
                i = j
                if sum(len(x[0]) for x in held) >= LEAVES or sum(len(x[3]) for x in held) >= POSTINGS:
                    flush()
        flush()
        item, rank = np.nonzero(best.score > 0)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (item, best.doc[item, rank], best.score[item, rank])], names=["item", "doc_id", "score"])

    return rows.mapInArrow(run, "item long, doc_id long, score long").withColumn("part", F.spark_partition_id() % 64)


def best_of(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Distinct (item_id, term) of items; rows with a null id have none."""
    term = F.explode(F.array_distinct(F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(TERM), 0)))
    return items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), term.alias("term")).distinct()


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Each item's k best documents with a score above 0 (all, if fewer): item_id, rank (from 1), doc_id and score.

    Terms are runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased. With N documents that have a term, L terms in
    all of them, n in one, df documents that hold a term and tf occurrences in one, a term weighs w = floor(1000 ln((2N+2)/(2df+1))) and a
    document's m is 10 + 90nN div L; the score sums w (10^9 tf div (1000 tf + 8m)) over the item's different terms. Equal scores go to the smaller doc_id.

    Null and empty texts have no terms. Documents and items with a null id are left out, of the counts too. Rows that repeat a doc_id are documents of
    their own and may take a rank each; rows that repeat an item_id are one item with the terms of all. Items of no term, or none that a document
    has, give no row. Other columns are ignored; empty tables give an empty result. Terms are told apart by 64-bit hashes.

    Items are searched in blocks of about `block` distinct (item, term) pairs, each in one pass over all documents.
    """
    store = Store(docs.sparkSession)
    docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(items.dtypes)[item_col]
    terms = store.save(item_terms(items, item_col, item_text_col))
    blocks = max(1, -(-terms.count() // block))
    results = []
    for b in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "term").collect()
        if not rows:
            continue
        words = sorted({r.term for r in rows})
        hashes = term_hashes(words)
        by_hash = np.argsort(hashes, kind="stable")
        place = dict(zip((words[x] for x in by_hash.tolist()), range(len(words))))
        ids = list(dict.fromkeys(r.item_id for r in rows))
        at = {x: n for n, x in enumerate(ids)}
        found = store.save(vectors(docs, hashes[by_hash]))
        n_docs, n_terms = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = dict(found.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
        weights = np.array([weight(n_docs, df.get(t, 0)) for t in range(len(words))], np.int64)
        held = Block(ids, hashes[by_hash], weights, np.array([at[r.item_id] for r in rows], np.int64), np.array([place[r.term] for r in rows], np.int64), n_docs, max(n_terms, 1))
        # The kth scores among some documents are bounds for all; what is in the result doesn't depend on which these are.
        some = best_of(searched(found.sample(min(1.0, FIRST / max(n_docs, 1)), seed=1), held, k), ["item"], k).where(F.col("rank") == k)
        bounds = [(0, np.iinfo(np.int64).max)] * len(held.ids)
        for r in some.collect():
            bounds[r.item] = (r.score, r.doc_id)
        best = store.save(best_of(best_of(searched(found, held, k, bounds), ["item", "part"], k).drop("rank"), ["item"], k))
        store.drop(found)
        names = docs.sparkSession.createDataFrame([(n, x) for n, x in enumerate(held.ids)], f"item long, item_id {kind}")
        results.append(best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    store.drop(terms)
    if not results:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out
