"""Scoring texts with a hierarchical Pitman-Yor bigram model, sampled by Gibbs over the whole corpus.

Every context (the word before) is a Chinese restaurant whose new tables are customers of one parent restaurant, which
all contexts share; the parent's new tables draw from the uniform base. A sweep reseats all customers of a dish of a
restaurant one by one, given the other tables of the last sweep (all restaurants at once, as parallel Gibbs samplers do);
predictive probabilities are averaged over sweeps.

Tokens move once, to the partition of their word: (word, context, document), packed. There everything about a word is at
hand but its contexts' totals. These are added up in partitions of contexts and sent back, in a fixed order that is agreed
on once, so that a sweep moves a byte or two for each context of a partition. Very frequent words are dealt over all
partitions by their contexts, and their few parent counts are added up on the side. Draws depend on word, context and
sweep alone, so results don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernels as K
from ._store import Store
from .descent import grouped

U = np.uint64
#: Bytes of text per partition of words, and bytes of text packed at once.
PART_BYTES, PACK_BYTES = 16 << 20, 8 << 20
#: Sweeps, and how many of the first are left out of the average.
SWEEPS, BURN_IN = 4, 1
STRENGTH = 1.0
#: Customers of a dish that sit down singly; of those after them a part of this size sits down at once.
SINGLY = 64
#: Parts of 1 in which sums of logarithms travel.
BASE_UNIT, SCORE_UNIT = float(1 << 30), float(1 << 26)
END, BEGIN = U(0x0E0D_0E0D_0E0D_0E0D), U(0xB0B0_B0B0_B0B0_B0B1)
#: Where scalars stand among sums; heavy words come after them.
SCALARS = 8


def pack(x: np.ndarray) -> bytes:
    """Whole numbers as zstd-compressed planes of their bytes."""
    width = next((w for w in (1, 2, 4) if not len(x) or int(x.max()) < 1 << (8 * w)), 8)
    planes = np.ascontiguousarray(x.astype(f"<u{width}")).view(np.uint8).reshape(len(x), width).T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(b: bytes) -> np.ndarray:
    width = b[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{width}").astype(np.int64 if width < 8 else U)


def pack_ids(x: np.ndarray) -> bytes:
    """Sorted 64-bit ids: the first, and the steps between them."""
    return x[:1].astype(np.int64).tobytes() + pack(np.diff(x).view(U))


def unpack_ids(b: bytes) -> np.ndarray:
    rest = unpack(b[8:]).view(np.int64)
    return np.frombuffer(b[:8], np.int64)[0] + np.concatenate([np.zeros(1, np.int64), np.cumsum(rest)])


def steps(x: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Differences of rising numbers, which start again at each new."""
    d = x.copy()
    d[1:] -= np.where(new[1:], 0, x[:-1])
    return d


def unsteps(d: np.ndarray, new: np.ndarray) -> np.ndarray:
    total = np.cumsum(d)
    first = np.flatnonzero(new)
    return total - np.repeat(total[first] - d[first], np.diff(np.concatenate([first, [len(d)]])))


def by_pair(word: np.ndarray, slot: np.ndarray, doc: np.ndarray, slots: int, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens in the order of (word, slot, doc)."""
    s, d = int(slots).bit_length(), int(docs).bit_length()
    if int(word.max(initial=0)).bit_length() + s + d < 63:
        key = np.sort((word << (s + d)) | (slot << d) | doc)
        return key >> (s + d), (key >> d) & ((1 << s) - 1), key & ((1 << d) - 1)
    o = np.lexsort((doc, slot, word))
    return word[o], slot[o], doc[o]


def sorted_pairs(word: np.ndarray, slot: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    o = np.argsort(word * (slots + 1) + slot)
    return word[o], slot[o], o


def starts(sizes: np.ndarray) -> np.ndarray:
    new = np.zeros(int(sizes.sum()), bool)
    new[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    return new


def tokens(part: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's hash, the hash of its context, and its document; every document ends with the end token."""
    start, end, at = K.words(part, off)
    h = K.word_hashes(part, start, end, True)
    n = np.diff(at) + 1
    to = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(n)), n)
    w = np.empty(to[-1], U)
    ends = to[1:] - 1
    inner = np.ones(len(w), bool)
    inner[ends] = False
    w[inner], w[ends] = h, END
    before = np.empty(len(w), U)
    before[1:] = w[:-1]
    before[to[:-1]] = BEGIN
    return w, before, doc


def uniform(key: np.ndarray, draw: np.ndarray | int) -> np.ndarray:
    """A number in [0, 1) for each key and draw, always the same."""
    return (K.mix(key + np.asarray(draw).astype(U) * U(0x9E3779B97F4A7C15)) >> U(11)) * 2.0**-53


def seat(c: np.ndarray, others: np.ndarray, prior: np.ndarray, discount: float, key: np.ndarray) -> np.ndarray:
    """Tables of a dish after its c customers sit down one by one: the next opens a table with odds
    (STRENGTH + discount * (others + tables)) * prior to (seated - discount * tables).

    others: tables of the restaurant's other dishes; prior: the parent's probability of the dish. Beyond SINGLY customers
    they come in groups of that part of those seated, between which the odds stay.
    """
    t = np.minimum(c, 1).astype(np.int64)
    rows = np.flatnonzero(c > 1)
    seated, tables = np.ones(len(rows), np.int64), np.ones(len(rows), np.int64)
    while len(rows):
        step = np.minimum(np.maximum(1, seated // SINGLY), c[rows] - seated)
        w = (STRENGTH + discount * (others[rows] + tables)) * prior[rows]
        p = w / (w + seated - discount * tables)
        if step.max() == 1:
            opened = uniform(key[rows], seated) < p
        else:
            r = np.repeat(np.arange(len(rows)), step)
            draw = np.arange(len(r)) - np.repeat(np.cumsum(step) - step, step) + seated[r]
            opened = np.bincount(r, uniform(key[rows][r], draw) < p[r], len(rows)).astype(np.int64)
        tables, seated = tables + opened, seated + step
        done = seated >= c[rows]
        t[rows[done]] = tables[done]
        rows, seated, tables = rows[~done], seated[~done], tables[~done]
    return t


@dataclass
class State:
    """What all partitions share: totals of sweep after sweep, and vectors over the very frequent words."""

    heavy: np.ndarray  # their hashes, sorted
    words: float = 0  # distinct training tokens
    total: float = 0  # training tokens
    d1: float = 0.5
    d0: float = 0.5
    heavy_count: np.ndarray = field(default_factory=lambda: np.zeros(0))
    heavy_tables: list[np.ndarray] = field(default_factory=list)  # customers of the parent; one vector per sweep, the first with a table for each word and context
    heavy_parent: list[np.ndarray] = field(default_factory=list)  # tables of the parent
    parent_customers: list[float] = field(default_factory=list)
    parent_tables: list[float] = field(default_factory=list)

    def base(self) -> float:
        return 1 / (self.words + 1)

    def seat_parent(self, k: np.ndarray, before: np.ndarray, key: np.ndarray, sweep: int) -> np.ndarray:
        """Tables of the parent for words with k customers, which had `before` tables in the last sweep."""
        return seat(k, self.parent_tables[sweep - 1] - before, np.full(len(k), self.base()), self.d0, K.mix(key ^ U(sweep << 8 | 1)))


class Partition:
    """The words of one partition, their contexts and training counts."""

    def __init__(self, row: dict, state: State):
        self.state = state
        self.w, size = np.frombuffer(row["w"], U), unpack(row["contexts"])
        self.ctx = np.frombuffer(row["ctx"], np.uint32)
        self.slot = unsteps(unpack(row["slots"]), starts(size))
        self.c = unpack(row["counts"])
        self.word = np.repeat(np.arange(len(self.w)), size)
        at = np.searchsorted(state.heavy, self.w)
        self.at = np.minimum(at, max(len(state.heavy) - 1, 0))
        self.is_heavy = state.heavy[self.at] == self.w if len(state.heavy) else np.zeros(len(self.w), bool)
        self.n = np.bincount(self.word, self.c, len(self.w)).astype(np.int64)  # of heavy words only a part
        self.seen = np.flatnonzero(self.c > 0)

    def per_word(self, own: np.ndarray, heavy: np.ndarray) -> np.ndarray:
        """Values of words: of heavy ones from all partitions."""
        return np.where(self.is_heavy, heavy[self.at], own) if len(self.state.heavy) else own

    def parent(self, t: np.ndarray, parent: np.ndarray, sweep: int) -> np.ndarray:
        """Each word's probability in the parent restaurant after a sweep that left t tables of the pairs."""
        s = self.state
        k = self.per_word(np.bincount(self.word, t, len(self.w)), s.heavy_tables[sweep])
        have = self.per_word(parent, s.heavy_parent[sweep])
        new = (STRENGTH + s.d0 * s.parent_tables[sweep]) * s.base()
        return (np.where(k > 0, k - s.d0 * have, 0) + new) / (STRENGTH + s.parent_customers[sweep])

    def first(self) -> tuple[np.ndarray, np.ndarray]:
        """A table for every pair that was seen, and one of the parent for every word."""
        t = np.minimum(self.c, 1)
        return t, np.minimum(np.bincount(self.word, t, len(self.w)), 1).astype(np.int64)

    def sweep(self, sweep: int, t: np.ndarray, parent: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Reseats all; t, parent: tables after the last sweep, tables: its totals of the contexts."""
        s, some = self.state, self.seen
        p = self.parent(t, parent, sweep - 1)
        key = K.mix(self.w[self.word[some]] + K.mix(self.ctx[self.slot[some]].astype(U) + U(sweep << 40)))
        new = np.zeros(len(self.c), np.int64)
        new[some] = seat(self.c[some], tables[self.slot[some]] - t[some], p[self.word[some]], s.d1, key)
        k = np.bincount(self.word, new, len(self.w)).astype(np.int64)
        return new, s.seat_parent(np.where(self.is_heavy, 0, k), parent, self.w, sweep)

    def probability(self, sweep: int, t: np.ndarray, parent: np.ndarray, tables: np.ndarray, customers: np.ndarray) -> np.ndarray:
        """Of every pair, after a sweep."""
        s = self.state
        up = self.parent(t, parent, sweep)[self.word]
        return (np.where(self.c > 0, self.c - s.d1 * t, 0) + (STRENGTH + s.d1 * tables[self.slot]) * up) / (STRENGTH + customers[self.slot])

    def sums(self, scalars: list, heavy_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, value) of scalars and of the heavy words' values."""
        of = np.bincount(self.at[self.is_heavy], heavy_values[self.is_heavy], len(self.state.heavy)).astype(np.int64)
        use = np.flatnonzero(of)
        return np.concatenate([np.arange(len(scalars)), SCALARS + use]), np.concatenate([np.array(scalars, np.int64), of[use]])


PARTS = "b int, r int, data binary, more binary, place long, value long"


def rows_of(r: int, cut: np.ndarray, values: list[np.ndarray], seats: tuple[np.ndarray, np.ndarray], sums: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """What a partition says after a sweep: its shares of the contexts' totals by partition of contexts (b from 0), its seats
    (b is -1) and sums (b is -2)."""
    full = np.flatnonzero(cut[1:] > cut[:-1])
    out = [(int(b), r, *(pack(v[cut[b] : cut[b + 1]]) for v in values), None, None) for b in full]
    out.append((-1, r, pack(seats[0]), pack(seats[1]), None, None))
    out += [(-2, r, None, None, int(k), int(v)) for k, v in zip(*sums)]
    return pa.RecordBatch.from_pylist([dict(zip(("b", "r", "data", "more", "place", "value"), x)) for x in out], schema=pa.schema([("b", pa.int32()), ("r", pa.int32()), ("data", pa.binary()), ("more", pa.binary()), ("place", pa.int64()), ("value", pa.int64())]))


def score(docs: DataFrame, held_out: int = 10, sweeps: int = SWEEPS, burn_in: int = BURN_IN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts (null: empty) are lower-cased in A-Z and split at ASCII space; an end token closes each. Documents whose
    crc32(id as text) mod `held_out` is 0 are not learned from. n_known counts tokens that occur in training, train_tokens is the
    number of training tokens. base_score is the log10 probability under add-0.1 unigrams, score under the model; both
    leave one share of probability to unknown words. Rows with a null id give no row; rows that repeat an id add up.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    store = Store(spark)
    context = spark.sparkContext
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    is_out = lambda c: F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(held_out)) == 0
    flagged = docs.withColumn("train", ~is_out("doc_id"))
    size = docs.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    bucket = lambda ctx: ((K.mix(ctx) >> U(32)) % U(parts)).astype(np.int64)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.buffers(batch.column("text"))
            for i, j in K.chunks(offsets):
                w, _, _ = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                u, n = np.unique(w, return_counts=True)
                some = n >= max(8, len(w) / (8 * parts))
                yield pa.RecordBatch.from_arrays([pa.array(u[some].view(np.int64)), pa.array(n[some])], names=["w", "n"])
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([len(w)], pa.int64())], names=["w", "n"])

    counts = store.save(docs.mapInArrow(frequent, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")))
    all_tokens = counts.where("w = 0").agg(F.sum("n")).first()[0] or 0
    heavy = np.sort(np.array([r.w for r in counts.where((F.col("w") != 0) & (F.col("n") >= all_tokens / (4 * parts))).collect()], np.int64).view(U))
    state = State(heavy)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            w = np.concatenate([x[0] for x in held])
            ctx = np.concatenate([x[1] for x in held])
            ids = np.concatenate([x[3] for x in held])
            order = np.argsort(ids, kind="stable")
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids))
            shift = np.cumsum([0, *(len(x[3]) for x in held)])
            doc = rank[np.concatenate([x[2] + s for x, s in zip(held, shift)])]
            ids, train = ids[order], np.concatenate([x[4] for x in held])[order]
            place = K.mix(w ^ U(0x77))
            if len(heavy):
                often = heavy[np.minimum(np.searchsorted(heavy, w), len(heavy) - 1)] == w
                place[often] = K.mix(place[often] + ctx[often] * U(0x9E3779B97F4A7C15))
            r = ((place >> U(32)) % U(parts)).astype(np.int64)
            o = np.argsort(r.astype(np.uint16 if parts < 1 << 16 else np.int64), kind="stable")
            w, ctx, doc, cut = w[o], ctx[o], doc[o], np.searchsorted(r[o], np.arange(parts + 1))
            rows: list[tuple] = []
            for p in np.flatnonzero(cut[1:] > cut[:-1]):
                part = slice(cut[p], cut[p + 1])
                words, wi = np.unique(w[part], return_inverse=True)
                contexts, ci = np.unique(ctx[part], return_inverse=True)
                use, d = np.unique(doc[part], return_inverse=True)
                wi, ci, d = by_pair(wi, ci, d, len(contexts), len(use))
                new = np.concatenate([[True], wi[1:] != wi[:-1]])
                n = np.diff(np.concatenate([np.flatnonzero(new), [len(wi)]]))
                rows.append((int(p), words.tobytes(), contexts.tobytes(), pack(n), pack(steps(ci, new)), pack(d), pack_ids(ids[use]), np.packbits(train[use]).tobytes()))
            c = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), *(pa.array(v, pa.binary()) for v in c[1:])], names=["r", "w", "ctx", "n", "slots", "doc", "ids", "train"])

        have = 0
        for batch in batches:
            data, offsets = K.buffers(batch.column("text"))
            ids, train = batch.column("doc_id").to_numpy(), batch.column("train").to_numpy(zero_copy_only=False)
            for i, j in K.chunks(offsets):
                held.append((*tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), ids[i:j], train[i:j]))
                have += int(offsets[j] - offsets[i])
                if have >= PACK_BYTES:
                    yield from flush()
                    held, have = [], 0
        if held:
            yield from flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each(t: pa.Table, begins: np.ndarray) -> pa.RecordBatch:
            out = []
            for a, b in zip(begins, begins[1:]):
                rows = t.slice(a, b - a).to_pylist()
                n = [unpack(x["n"]) for x in rows]
                sizes = [int(x.sum()) for x in n]
                words, wi = np.unique(np.concatenate([np.frombuffer(x["w"], U) for x in rows]), return_inverse=True)
                ids = [unpack_ids(x["ids"]) for x in rows]
                docs_, di = np.unique(np.concatenate(ids), return_inverse=True)
                train = np.zeros(len(docs_), bool)
                train[di] = np.concatenate([np.unpackbits(np.frombuffer(x["train"], np.uint8))[: len(d)] for x, d in zip(rows, ids)]).astype(bool)
                contexts, ci = np.unique(np.concatenate([np.frombuffer(x["ctx"], U) for x in rows]), return_inverse=True)
                shift, move = np.cumsum([0, *map(len, ids)]), np.cumsum([0, *(len(x["ctx"]) // 8 for x in rows)])
                doc = np.concatenate([di[unpack(x["doc"]) + s] for x, s in zip(rows, shift)])
                slot = np.concatenate([ci[unsteps(unpack(x["slots"]), starts(m)) + s] for x, m, s in zip(rows, n, move)])
                word, slot, doc = by_pair(np.repeat(wi, np.concatenate(n)), slot, doc, len(contexts), len(docs_))
                at = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (slot[1:] != slot[:-1])]))
                occ = np.diff(np.concatenate([at, [len(word)]]))
                count = np.add.reduceat(train[doc].astype(np.int64), at)
                word, slot = word[at], slot[at]
                size = np.bincount(word, minlength=len(words))
                # contexts stand by their partition, so that what comes back from there can be put in its place
                o = np.argsort(bucket(contexts), kind="stable")
                place = np.empty(len(o), np.int64)
                place[o] = np.arange(len(o))
                word, slot, order = sorted_pairs(word, place[slot], len(contexts))
                begin = np.cumsum(occ) - occ
                count, occ, begin = count[order], occ[order], begin[order]
                doc = doc[np.repeat(begin, occ) + np.arange(occ.sum()) - np.repeat(np.cumsum(occ) - occ, occ)]
                out.append((rows[0]["r"], words.tobytes(), contexts[o].tobytes(), pack(size), pack(steps(slot, starts(size))), pack(count), pack(occ), pack(doc), pack_ids(docs_)))
            c = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), *(pa.array(v, pa.binary()) for v in c[1:])], names=["r", "w", "full", "contexts", "slots", "counts", "occ", "doc", "ids"])

        yield from grouped(batches, ["r"], each, 1)

    dealt = flagged.mapInArrow(deal, "r int, w binary, ctx binary, n binary, slots binary, doc binary, ids binary, train binary")
    columns = "r int, w binary, full binary, contexts binary, slots binary, counts binary, occ binary, doc binary, ids binary"
    table = store.save(dealt.repartition(parts, "r").sortWithinPartitions("r").mapInArrow(gather, columns))

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every partition's contexts with their customers, by partition of contexts; its first seats and its sums."""
        for batch in batches:
            for row in batch.to_pylist():
                full = np.frombuffer(row["full"], U)
                p = Partition({**row, "ctx": full.astype(np.uint32).tobytes()}, now.value)
                cut = np.searchsorted(bucket(full), np.arange(parts + 1))
                t, parent = p.first()
                k = np.bincount(p.word, t, len(p.w))
                light = ~p.is_heavy
                scalars = [p.n.sum(), ((p.n > 0) & light).sum(), (p.c == 1).sum(), (p.c == 2).sum(), ((k == 1) & light).sum(), ((k == 2) & light).sum(), k.sum(), parent[light].sum()]
                own = [np.bincount(p.slot, v, len(full)).astype(np.int64) for v in (p.c, t)]
                yield rows_of(row["r"], cut, own, (t, parent), p.sums(scalars, k))
                counts = p.sums([], p.n)
                yield rows_of(row["r"], np.zeros(1, np.int64), own, (t, parent), (counts[0] + len(heavy), counts[1])).filter(pa.array([False] + [True] * len(counts[0])))
                use = np.flatnonzero(cut[1:] > cut[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(-3 - use.astype(np.int32)), pa.array([row["r"]] * len(use), pa.int32()), pa.array([full[cut[b] : cut[b + 1]].tobytes() for b in use], pa.binary()), pa.nulls(len(use), pa.binary()), pa.nulls(len(use), pa.int64()), pa.nulls(len(use), pa.int64())], names=["b", "r", "data", "more", "place", "value"])

    def agree(own: pa.Table, ids: pa.Table) -> pa.Table:
        """A partition of contexts: where each partition of words finds its contexts, and the totals of customers and tables."""
        of = {r: np.frombuffer(x, U) for r, x in zip(ids["r"].to_pylist(), ids["data"].to_pylist())}
        rs = sorted(of)
        u, inv = np.unique(np.concatenate([of[r] for r in rs]), return_inverse=True)
        cut = np.cumsum([0, *(len(of[r]) for r in rs)])
        idx = {r: inv[a:b] for r, a, b in zip(rs, cut, cut[1:])}
        sums = np.zeros((2, len(u)), np.int64)
        for row in own.to_pylist():
            for k, c in enumerate(("data", "more")):
                sums[k][idx[row["r"]]] += unpack(row[c])
        b = own["b"][0].as_py()
        ints = (pa.array(x, pa.int32()) for x in ([b] * len(rs), rs, [len(u)] * len(rs)))
        packed = (pa.array([pack(x) for x in v], pa.binary()) for v in ([idx[r] for r in rs], [sums[0][idx[r]] for r in rs], [sums[1][idx[r]] for r in rs]))
        return pa.table(dict(zip(("b", "r", "size", "idx", "customers", "tables"), (*ints, *packed))))

    def total_of(own: pa.Table, routes: pa.Table) -> pa.Table:
        idx = {r: unpack(x) for r, x in zip(routes["r"].to_pylist(), routes["idx"].to_pylist())}
        total = np.zeros(routes["size"][0].as_py(), np.int64)
        for row in own.to_pylist():
            total[idx[row["r"]]] += unpack(row["data"])
        b = routes["b"][0].as_py()
        return pa.table({"b": pa.array([b] * len(idx), pa.int32()), "r": pa.array(list(idx), pa.int32()), "tables": pa.array([pack(total[x]) for x in idx.values()], pa.binary())})

    def together(a: DataFrame, b: DataFrame, key: str):
        """Groups of both by a partition's number, a task for each however large the corpus is."""
        return a.repartition(parts, key).groupBy(key).cogroup(b.repartition(parts, key).groupBy(key))

    def sums_of(said: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        found = said.where("b = -2").groupBy("place").agg(F.sum("value").alias("value")).collect()
        v = np.zeros(SCALARS + 2 * len(heavy), np.int64)
        for r in found:
            v[r.place] = r.value
        return v[:SCALARS], v[SCALARS:]

    now = context.broadcast(state)
    said = store.save(table.select("r", "w", "full", "contexts", "slots", "counts").mapInArrow(survey, PARTS))
    ids = said.where("b <= -3").select((-3 - F.col("b")).cast("int").alias("b"), "r", "data")
    own = said.where("b >= 0").select("b", "r", "data", "more")
    routes = store.save(together(own, ids, "b").applyInArrow(agree, "b int, r int, size int, idx binary, customers binary, tables binary"))
    scalars, vectors = sums_of(said)
    of_heavy, state.heavy_count = vectors[: len(heavy)], vectors[len(heavy) :]
    state.total, state.words = float(scalars[0]), float(scalars[1] + (state.heavy_count > 0).sum())
    d = lambda one, two: float(min(max(one / max(one + 2 * two, 1), 0.05), 0.95))
    state.d1, state.d0 = d(scalars[2], scalars[3]), d(scalars[4] + (of_heavy == 1).sum(), scalars[5] + (of_heavy == 2).sum())

    def keep(customers: np.ndarray, tables_of_light: int, parent: np.ndarray, k: int) -> None:
        state.heavy_tables.append(customers)
        state.heavy_parent.append(parent)
        state.parent_customers.append(float(k))
        state.parent_tables.append(float(tables_of_light + parent.sum()))

    keep(of_heavy, scalars[7], np.minimum(of_heavy, 1), scalars[6])
    thin = lambda b: np.frombuffer(b, U).astype(np.uint32).tobytes()

    def slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = pa.array([thin(x.as_py()) for x in batch.column("full")], pa.binary())
            yield batch.set_column(batch.schema.get_field_index("full"), "ctx", short)

    model = table.select("r", "w", "full", "contexts", "slots", "counts").mapInArrow(slim, "r int, w binary, ctx binary, contexts binary, slots binary, counts binary")
    nothing = F.lit(None).cast("binary")
    seats = [said.where("b = -1").select("r", F.lit(0).alias("sweep"), "b", "data", "more")]
    totals = [routes.select("r", F.lit(0).alias("sweep"), "b", F.col("tables").alias("data"), nothing.alias("more"))]

    def unfold(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tables of pairs, tables of the parent, totals of contexts) of a sweep from its rows."""
        rows = sorted(rows, key=lambda x: x["b"])
        t = next(x for x in rows if x["b"] == -1)
        return unpack(t["data"]), unpack(t["more"]), np.concatenate([unpack(x["data"]) for x in rows if x["b"] >= 0])

    def sweep_over(k: int, now) -> DataFrame:
        def run(model: pa.Table, last: pa.Table) -> pa.Table:
            row = model.to_pylist()[0]
            p = Partition(row, now.value)
            t, parent, tables = unfold(last.to_pylist())
            sizes = {x["b"]: len(unpack(x["data"])) for x in last.to_pylist() if x["b"] >= 0}
            t, parent = p.sweep(k, t, parent, tables)
            cut = np.concatenate([[0], np.cumsum([sizes.get(b, 0) for b in range(parts)])])
            own = np.bincount(p.slot, t, len(p.ctx)).astype(np.int64)
            n = np.bincount(p.word, t, len(p.w)).astype(np.int64)
            return pa.Table.from_batches([rows_of(row["r"], cut, [own, np.zeros(len(own), np.int64)], (t, parent), p.sums([n.sum(), parent[~p.is_heavy].sum()], n))])

        return store.save(together(model, seats[-1].unionByName(totals[-1]), "r").applyInArrow(run, PARTS))

    for k in range(1, sweeps + 1):
        said = sweep_over(k, context.broadcast(state))
        scalars, vectors = sums_of(said)
        of_heavy = vectors[: len(heavy)]
        parent = state.seat_parent(of_heavy, state.heavy_parent[-1], heavy, k)
        keep(of_heavy, scalars[1], parent, scalars[0])
        seats.append(said.where("b = -1").select("r", F.lit(k).alias("sweep"), "b", "data", "more"))
        total = store.save(together(said.where("b >= 0").select("b", "r", "data"), routes.select("b", "r", "idx", "size"), "b").applyInArrow(total_of, "b int, r int, tables binary"))
        totals.append(total.select("r", F.lit(k).alias("sweep"), "b", F.col("tables").alias("data"), nothing.alias("more")))
    final = context.broadcast(state)
    homes = int(spark.conf.get("spark.sql.shuffle.partitions"))  # partitions of documents, where their scores are added up

    averaged = range(burn_in + 1, sweeps + 1) if sweeps > burn_in else range(sweeps + 1)
    customers = routes.select("r", F.lit(-1).alias("sweep"), "b", F.col("customers").alias("data"), nothing.alias("more"))
    states = customers
    for k in averaged:
        states = states.unionByName(seats[k]).unionByName(totals[k])

    def rate(model: pa.Table, states: pa.Table) -> pa.Table:
        s = final.value
        row = model.to_pylist()[0]
        p = Partition({**row, "ctx": thin(row["full"])}, s)
        by_sweep: dict[int, list] = {}
        for x in states.to_pylist():
            by_sweep.setdefault(x["sweep"], []).append(x)
        customers = np.concatenate([unpack(x["data"]) for x in sorted(by_sweep[-1], key=lambda x: x["b"])])
        prob = sum(p.probability(k, *unfold(by_sweep[k]), customers) for k in averaged) / len(averaged)
        n = p.per_word(p.n, s.heavy_count)
        occ, doc, ids = unpack(row["occ"]), unpack(row["doc"]), unpack_ids(row["ids"])
        pair = np.repeat(np.arange(len(occ)), occ)
        word = p.word[pair]
        # Sums of a document's tokens here, as whole numbers that take few bytes: log10(c + 0.1) is at least -1, log10 of a probability at most 0.
        n_tokens, n_known = np.bincount(doc, minlength=len(ids)), np.bincount(doc[(n > 0)[word]], minlength=len(ids))
        base = np.rint((np.bincount(doc, np.log10(n + 0.1)[word], len(ids)) + n_tokens) * BASE_UNIT).astype(np.int64)
        mine = np.bincount(doc, np.rint(-np.log10(prob) * SCORE_UNIT)[pair], len(ids)).astype(np.int64)  # rounded one by one, so that sums don't depend on partitions
        home = ((K.mix(ids.view(U)) >> U(33)) % U(homes)).astype(np.int64)
        o = np.argsort(home, kind="stable")
        cut = np.searchsorted(home[o], np.arange(homes + 1))
        rows = [(int(b), pack_ids(ids[x]), *(pack(v[x]) for v in (n_tokens, n_known, base, mine))) for b in np.flatnonzero(cut[1:] > cut[:-1]) for x in [o[cut[b] : cut[b + 1]]]]
        return pa.Table.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[c] for r in rows], pa.binary()) for c in range(1, 6))], names=["bucket", "ids", "tokens", "known", "base", "score"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each(t: pa.Table, begins: np.ndarray) -> pa.RecordBatch:
            out = []
            for a, b in zip(begins, begins[1:]):
                rows = t.slice(a, b - a).to_pylist()
                ids, at = np.unique(np.concatenate([unpack_ids(r["ids"]) for r in rows]), return_inverse=True)
                sums = [np.zeros(len(ids), np.int64) for _ in range(4)]
                for v, c in zip(sums, ("tokens", "known", "base", "score")):
                    np.add.at(v, at, np.concatenate([unpack(r[c]).astype(np.int64) for r in rows]))
                out.append((ids, *sums))
            ids, n_tokens, n_known, base, mine = (np.concatenate(c) for c in zip(*out))
            base = base / BASE_UNIT - n_tokens - n_tokens * np.log10(state.total + 0.1 * (state.words + 1))
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n_tokens), pa.array(n_known), pa.array(base), pa.array(-mine / SCORE_UNIT)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

        yield from grouped(batches, ["bucket"], each, 1)

    rated = together(table, states, "r").applyInArrow(rate, "bucket int, ids binary, tokens binary, known binary, base binary, score binary")
    out = rated.repartition(homes, "bucket").sortWithinPartitions("bucket").mapInArrow(total, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", is_out("doc_id").alias("held_out"), "n_tokens", "n_known", F.lit(int(state.total)).cast("long").alias("train_tokens"), "base_score", "score")
