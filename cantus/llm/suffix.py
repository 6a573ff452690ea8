"""Substring dedup by longest-previous-factor arrays.

Byte strings that share a minimiser meet in one bucket. There a suffix array is built; the previous and next smaller
positions in suffix order give every position its longest earlier match (the LPF array) and where that match stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernels as K
from ._store import Store
from .repeats import attach, keyed_by_text, repeated_spans


def suffix_array(x: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes of the integers x in order, and ranks by their first 4, 8, 16, ... symbols (a power of two that fits a
    number at first). Symbols must make suffixes differ early (unique ends)."""
    n, levels = len(x), []
    bits = max(1, int(x.max()).bit_length())
    have = 1 << ((62 // bits).bit_length() - 1)
    padded = np.concatenate([x + 1, np.zeros(have, np.int64)])
    bits = max(1, int(padded.max()).bit_length())
    have = min(have, 1 << ((62 // bits).bit_length() - 1))
    key = padded[:n]
    for k in range(1, have):
        key = (key << bits) | padded[k : n + k]
    while True:
        o = np.argsort(key)  # ties share a rank, so their order is free
        rank = np.empty(n, np.int64)
        rank[o] = np.cumsum(np.concatenate([[0], key[o][1:] != key[o][:-1]]))
        levels.append((have, rank))
        if rank[o[-1]] == n - 1 or have > n:
            return o, levels
        after = np.full(n, -1, np.int64)
        if have < n:
            after[:-have] = rank[have:]
        key = rank * (n + 1) + after + 1
        have *= 2


def common_prefixes(x: np.ndarray, sa: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The common prefix of each suffix with the one before it in order."""
    n = len(sa)
    out = np.zeros(n, np.int64)
    p, q = sa[1:], sa[:-1]
    l = np.zeros(n - 1, np.int64)
    for size, rank in [*reversed(levels), *[(1, x)] * (levels[0][0] - 1)]:
        fits = np.maximum(p, q) + l + size <= n
        same = fits & (rank[np.minimum(p + l, n - 1)] == rank[np.minimum(q + l, n - 1)])
        l += size * same
    out[1:] = l
    return out


def longest_previous(x: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For each position the length of the longest match that starts earlier (0 if it is under `least`) and its start (-1)."""
    n = len(x)
    length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    if n < 2:
        return length, source
    sa, levels = suffix_array(x)
    lcp = common_prefixes(x, sa, levels)
    lcp[lcp < least] = 0
    near = lcp > 0
    near[:-1] |= lcp[1:] > 0
    k = np.flatnonzero(near)  # only these have a neighbour with a long enough match
    for order, common in ((sa[k].tolist(), lcp[k].tolist()), (sa[k][::-1].tolist(), np.concatenate([[0], lcp[k][:0:-1]]).tolist())):
        stack: list[tuple[int, int]] = []
        for p, c in zip(order, common):
            while stack and stack[-1][0] > p:  # what stays on top is the nearest smaller position
                c = min(c, stack.pop()[1])
            if stack and c > length[p]:
                length[p], source[p] = c, stack[-1][0]
            stack.append((p, c))
    return length, source


def previous_factor_windows(window: int, keep_first: bool):
    """The bucket kernel: windows whose LPF reaches `window`, and their sources unless the first copies stay."""

    def kernel(texts: list[bytes], begins: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([len(t) + 1 for t in texts])
        starts = ends - np.array([len(t) + 1 for t in texts])
        x = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64)
        x[ends - 1] = 256 + np.arange(len(texts))
        length, source = longest_previous(x, window)
        hit = length >= window
        if not keep_first:
            hit[source[hit]] = True
        return [np.flatnonzero(hit[s : s + m]) for s, m in zip(starts, n)]

    return kernel


def drop_repeated_bytes(docs: DataFrame, length: int = 200, gram: int = 40, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary: what is left).

    Texts are UTF-8 bytes; matches never cross documents. A byte is removed if a string of `length` bytes that covers it
    also starts anywhere else, in the same document included; with keep_first, only if it also starts earlier (a smaller
    doc_id, or earlier in the document), so that the first copy stays. Strings are judged on the input. Strings that
    start in equal stretches around one minimiser (equal runs) recur by that; what stretches that differ share is found by the LPF array.

    Null and empty texts have no bytes. Texts shorter than `length` stay whole. Rows with a null id give no row; rows
    that repeat an id give one each, and count as copies of each other (with keep_first, different texts of an id are in
    the order of a hash, and equal ones stand at the same place). Other columns are ignored; an empty table gives an empty result.
    """
    store = Store(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    docs = keyed_by_text(docs)
    spans = repeated_spans(store, docs, "byte", length, gram, keep_first, previous_factor_windows(length, keep_first))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.buffers(batch.column("text"))
            marks = batch.column("spans").to_pylist()
            for i, j in K.chunks(offsets):
                part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                keep, runs = np.ones(len(part), bool), np.zeros(j - i, np.int64)
                for d in range(i, j):
                    if marks[d]:
                        for a, b in np.frombuffer(marks[d], np.int64).reshape(-1, 2):
                            a, b = off[d - i] + a, min(off[d - i] + b, off[d - i + 1])
                            if a < b:
                                keep[a:b] = False
                                runs[d - i] += 1
                n = np.diff(off)
                kept = np.diff(np.concatenate([[0], np.cumsum(keep)])[off])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(n.astype(np.int64)), pa.array((n - kept).astype(np.int64)), pa.array(runs), K.kept_bytes(part, off, keep, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return attach(docs, spans).mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
