"""Windows of a fixed number of units (words or bytes) that occur more than once in a corpus.

Consecutive windows that share a minimiser are one run (a super-k-mer), and runs meet in their minimiser's bucket. A
minimiser that occurs once can't lie in a repeated window. Equal runs (told by 128-bit digests of their content) are folded
into one class with its number of copies before anything is shipped; classes that share a bucket travel as packed text to
the kernel, which decides which of their windows recur. A bucket with more classes than one task should hold is dealt into
finer buckets, of windows that share a longer core, for the same kernel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernels as K
from ._store import Store, small, spread_join

#: Classes that a kernel's bucket holds at most; what has more is cut finer first, with the same result.
HOT = 3000
#: Bytes of packed runs that a bucket kernel gets at once (a bucket stays whole).
BUCKET = 1 << 18
#: Where a run's offset is zero in its 12 bits.
ZERO = 2048

#: (packed texts, where each bucket's runs begin, number of windows of each) to hits: for each run, repeated windows' indices
Kernel = Callable[[list[bytes], np.ndarray, np.ndarray], list[np.ndarray]]
#: A text: its id, and a hash of it where an id has several texts.
DOC = ["doc_id", "t"]


def place(start: np.ndarray, offset: np.ndarray | int, n: np.ndarray | int) -> np.ndarray:
    """A run in one number: its first window's start, that window's offset from the minimiser (or block), and its number of
    windows. Order is by start."""
    return (start << 24) | ((offset + ZERO) << 12) | n


def units(part: np.ndarray, off: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Hashes of the units of a chunk of texts, where documents begin, and words' starts and ends."""
    if unit == "byte":
        return K.BYTES[part], off, None, None
    start, end, at = K.words(part, off)
    return K.word_hashes(part, start, end, False), at, start, end


def packed(part: np.ndarray, first: np.ndarray | None, last: np.ndarray | None) -> tuple[bytes, np.ndarray | None, np.ndarray | None]:
    """The units as one string (words with single spaces) and where they start and end in it."""
    if first is None:
        return part.tobytes(), None, None
    spaced, first, last = K.single_spaced(part, first, last)
    return spaced.tobytes(), first, last


def keyed_by_text(docs: DataFrame) -> DataFrame:
    """docs with t, which tells apart different texts of one id (0 where no id has several)."""
    t = F.xxhash64("text")
    several = docs.groupBy("doc_id").agg(F.min(t).alias("a"), F.max(t).alias("b")).where("a <> b").take(1)
    return docs.withColumn("t", t if several else F.lit(0).cast("long"))


def repeated_spans(store: Store, docs: DataFrame, unit: str, window: int, gram: int, keep_first: bool, kernel: Kernel) -> DataFrame:
    """(doc_id, t, spans): for every text with any, the maximal runs of units covered by repeated windows, packed as
    int64 pairs (start, end).

    docs: (doc_id, t, text). A window counts as repeated if the same units also start elsewhere; with keep_first, only if
    they also start earlier, at a smaller (doc_id, t, start).
    """
    if window > 2000:
        raise ValueError("windows of at most 2000 units")  # place() has 12 bits for each part
    where = "doc_id long, t long, place long"
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.buffers(batch.column("text"))
            ids, t = batch.column("doc_id").to_numpy(), batch.column("t").to_numpy()
            for i, j in K.chunks(offsets):
                part = data[offsets[i] : offsets[j]]
                h, at, first, last = units(part, offsets[i : j + 1] - offsets[i], unit)
                doc, start, n, m, anchor = K.segments(h, at, window, gram, unit)
                raw, first, last = packed(part, first, last)
                s = at[doc] + start
                e = s + n + window - 1
                run = K.digests(raw, s, e) if first is None else K.digests(raw, first[s], last[e - 1])
                cols = (ids[i:j][doc], t[i:j][doc], place(start, -m, n), anchor.view(np.int64), run[:, 0], run[:, 1])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["doc_id", "t", "place", "key", "r0", "r1"])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The wanted runs of each text, as packed strings."""
        for batch in batches:
            data, offsets = K.buffers(batch.column("text"))
            wanted = batch.column("wanted").to_pylist()
            ids, t = batch.column("doc_id").to_pylist(), batch.column("t").to_pylist()
            for i, j in K.chunks(offsets):
                part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                if unit == "byte":
                    at, first, last = off, None, None
                else:
                    first, last, at = K.words(part, off)
                raw, first, last = packed(part, first, last)
                out: list[tuple] = []
                for d in range(i, j):
                    base = int(at[d - i])
                    for w in wanted[d]:
                        s = base + (w["place"] >> 24)
                        e = s + (w["place"] & 0xFFF) + window - 1
                        out.append((w["key"], ids[d], t[d], w["place"], raw[s:e] if first is None else raw[first[s] : last[e - 1]]))
                c = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:4]), pa.array(c[4], pa.binary())], names=["key", "doc_id", "t", "place", "packed"])

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= BUCKET:
                table = pa.Table.from_batches(held).combine_chunks()
                key = table["key"].to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on; rows come sorted by key
                if cut:
                    yield from settle(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                size = sum(b.nbytes for b in held)
        if held:
            yield from settle(pa.Table.from_batches(held).combine_chunks())

    def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        key, at = table["key"].to_numpy(), table["place"].to_numpy()
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        texts = table["packed"].to_pylist()
        total = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        cuts = [0]
        for b in begins[1:].tolist():  # buckets go to the kernel in groups of bounded size
            if total[b] - total[cuts[-1]] >= BUCKET:
                cuts.append(b)
        cuts.append(table.num_rows)
        for x, y in zip(cuts, cuts[1:]):
            own = begins[(begins >= x) & (begins < y)] - x
            hits = kernel(texts[x:y], np.concatenate([own, [y - x]]), at[x:y] & 0xFFF)
            n = np.array([len(h) for h in hits])
            row = np.repeat(np.arange(x, y), n)
            k = np.concatenate([*hits, np.zeros(0, np.int64)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(table["doc_id"].to_numpy()[row]), pa.array(table["t"].to_numpy()[row]), pa.array(place((at[row] >> 24) + k, 0, 1))], names=[*DOC, "place"])

    def finer(width: int):
        """Cuts packed runs into blocks of `width` windows, keyed by the units that all windows of a block share. Equal
        windows stand at the same offset, so in the same block."""

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, ids, t = (batch.column(c).to_numpy() for c in ("place", "doc_id", "t"))
                data, offsets = K.buffers(batch.column("packed"))
                for i, j in K.chunks(offsets):
                    part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                    h, begin, first, last = units(part, off, unit)
                    start, o, n = at[i:j] >> 24, ((at[i:j] >> 12) & 0xFFF) - ZERO, at[i:j] & 0xFFF
                    row = np.repeat(np.arange(j - i), n)
                    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    b = (o[row] + k) // width
                    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (b[1:] != b[:-1])])) if len(row) else np.zeros(0, np.int64)
                    size = np.diff(np.concatenate([new, [len(row)]]))
                    row, k, b = row[new], k[new], b[new]
                    s = begin[row] + k
                    e = s + size + window - 1
                    core = begin[row] + (b + 1) * width - 1 - o[row]
                    c = K.mix(K.ranges(K.prefix(h, "word"), core, core + window - width + 1, "word") ^ K.mix(b.astype(np.uint64)))
                    raw = part.tobytes()
                    x, y = (s, e) if unit == "byte" else (first[s], last[e - 1])
                    run = K.digests(raw, x, y)
                    cols = (c.view(np.int64), ids[i:j][row], t[i:j][row], place(start[row] + k, o[row] + k - b * width, size), run[:, 0], run[:, 1])
                    yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in cols), pa.array([raw[u:v] for u, v in zip(x.tolist(), y.tolist())], pa.binary())], names=["key", *DOC, "place", "r0", "r1", "packed"])

        return cut

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("places")
            o, v = places.offsets.to_numpy(), places.values.to_numpy()
            out = []
            for i in range(batch.num_rows):
                p = v[o[i] : o[i + 1]]
                s, e = K.union(p >> 24, (p >> 24) + (p & 0xFFF) + window - 1)
                out.append(np.stack([s, e], 1).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(out, pa.binary())], names=[*DOC, "spans"])

    def folded(rows: DataFrame, n_rows: int, *more: str) -> tuple[DataFrame, DataFrame]:
        """(classes, marks): each class (key, r0, r1) once, at its first place, with n copies; and the copies that recur
        by being there more than once: all of a class, or with keep_first those after the first."""
        first = F.min(F.struct(*DOC, "place", *more)).alias("first")
        classes = store.save(rows.groupBy("key", "r0", "r1").agg(F.count(F.lit(1)).alias("n"), first))
        copied = classes.where("n > 1").select("key", "r0", "r1", "n", F.struct(*(F.col(f"first.{c}") for c in (*DOC, "place"))).alias("first"))
        marks = spread_join(rows.select(*DOC, "place", "key", "r0", "r1"), copied, ["key", "r0", "r1"], "n", n_rows)
        marks = marks.where(F.struct(*DOC, "place") != F.col("first")) if keep_first else marks
        return classes, marks.select(*DOC, "place")

    found = store.save(docs.mapInArrow(runs, f"{where}, key long, r0 long, r1 long"))
    n_found = found.count()
    often = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("r0").alias("lo"), F.max("r0").alias("hi")).where("n > 1")
    often = store.save(often.select("key", "n", (F.col("lo") != F.col("hi")).alias("mixed")))
    again = store.save(spread_join(found, often, ["key"], "n", n_found).drop("n"))
    store.drop(found, often)
    classes, marks = folded(again, n_found, "mixed")
    wanted = classes.where("first.mixed").select("first.doc_id", "first.t", F.struct("first.place", "key").alias("w"))
    wanted = store.save(wanted.groupBy(*DOC).agg(F.collect_list("w").alias("wanted")))
    level = store.save(docs.join(wanted.hint("merge"), DOC).mapInArrow(slices, f"key long, {where}, packed binary"))
    store.drop(wanted)
    marks = [marks]
    kept = [again, classes]
    for width in (max(4, window // 12), 4, 1, None):
        large = store.save(level.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("key"))
        n_large = large.count()
        cold = level.join(small(large, n_large, 16), "key", "left_anti") if n_large else level
        marks.append(cold.repartition(parts, "key").sortWithinPartitions("key", *DOC, "place").mapInArrow(buckets, where))
        kept.append(level)
        if not n_large:
            break
        hot = store.save(level.join(small(large, n_large, 16), "key", "left_semi").mapInArrow(finer(width), f"key long, {where}, r0 long, r1 long, packed binary"))
        classes, copies = folded(hot, hot.count(), "packed")
        marks.append(copies)
        kept += [hot, classes]
        level = classes.select("key", "first.doc_id", "first.t", "first.place", "first.packed")
    every = marks[0]
    for m in marks[1:]:
        every = every.unionByName(m)
    spans = store.save(every.groupBy(*DOC).agg(F.collect_list("place").alias("places")).mapInArrow(merge, "doc_id long, t long, spans binary"))
    store.drop(*{x._cantus_path: x for x in kept if hasattr(x, "_cantus_path")}.values())
    return spans


def attach(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with their spans (null where there are none)."""
    return docs.join(spans.hint("merge"), DOC, "left").drop("t")
