"""Substring dedup: word windows that also start earlier in the corpus are removed, the first of them stays.

Consecutive windows that share a minimiser travel as one packed string (super-k-mer) to the minimiser's bucket, where
sorting the windows counts them exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernels as K
from ._store import Store
from .repeats import attach, keyed_by_text, repeated_spans


def sorted_windows(window: int):
    """The bucket kernel: sorts a chunk's windows by bucket and content; every window after the first of its run is a hit."""

    def kernel(texts: list[bytes], begins: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        start, end, at = K.words(data, off)
        row = np.repeat(np.arange(len(texts)), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        w = np.stack([K.chained(K.word_hashes(data, start, end, False, seed), at[row] + k, window, seed) for seed in (1, 2)], 1)
        bucket = np.searchsorted(begins, row, "right")
        o = np.lexsort((w[:, 1], w[:, 0], bucket))  # stable: rows come in order of (doc_id, start)
        same = (bucket[o][1:] == bucket[o][:-1]) & (w[o][1:] == w[o][:-1]).all(1)
        hit = np.zeros(len(row), bool)
        hit[o[1:][same]] = True
        return [k[a:b][hit[a:b]] for a, b in zip(np.cumsum(n) - n, np.cumsum(n))]

    return kernel


def drop_repeated_windows(docs: DataFrame, window: int = 20, gram: int = 6, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, the columns named in `carry`, n_words, n_removed, text (the removed words cut out, the rest of the text as it was)
    and kept_words (the kept words joined by one space).

    Words are runs other than ASCII space, unchanged. A word is removed if a window of `window` words that covers it also
    starts earlier: in a smaller doc_id, or earlier in the same document. Windows are judged on the input.

    Null and blank texts have no words and stay as they are; a null text stays null, its kept_words are empty. Texts of
    fewer words than a window stay whole. Rows with a null id give no row. Rows that repeat an id and a
    text stand at the same place: neither is earlier than the other; different texts of an id are in the order of a hash. Other columns are ignored; an empty table gives an empty result.
    """
    store = Store(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (F.struct(*carry) if carry else F.lit(0)).alias("carried")).where("doc_id is not null")
    docs = keyed_by_text(docs)
    spans = repeated_spans(store, docs.select("doc_id", "t", "text"), "word", window, gram, True, sorted_windows(window))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            data, offsets = K.buffers(column)
            marks = batch.column("spans").to_pylist()
            for i, j in K.chunks(offsets):
                part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                start, end, at = K.words(part, off)
                keep = np.ones(len(start), bool)
                byte = np.ones(len(part), bool)
                for d in range(i, j):
                    if marks[d]:
                        base, stop = at[d - i], at[d - i + 1]
                        for a, b in np.frombuffer(marks[d], np.int64).reshape(-1, 2):
                            a, b = int(base + a), int(min(base + b, stop))
                            if a < b:
                                keep[a:b] = False
                                byte[start[a] : start[b] if b < stop else off[d - i + 1]] = False
                n = np.diff(at)
                removed = n - np.diff(np.concatenate([[0], np.cumsum(keep)])[at])
                texts = K.kept_bytes(part, off, byte)
                texts = pa.array([None if null else t for null, t in zip(column.slice(i, j - i).is_null().to_pylist(), texts.to_pylist())], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), batch.column("carried").slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(removed.astype(np.int64)), texts, K.joined(part, off, start, end, at, keep)],
                    names=["doc_id", "carried", "n_words", "n_removed", "text", "kept_words"],
                )

    kind = docs.schema["carried"].dataType.simpleString()
    out = attach(docs, spans).mapInArrow(cut, f"doc_id long, carried {kind}, n_words long, n_removed long, text string, kept_words string")
    return out.select("doc_id", *(F.col("carried").getField(c).alias(c) for c in carry), "n_words", "n_removed", "text", "kept_words")
