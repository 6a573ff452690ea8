"""Packing token sequences of bounded length by swap-based local search.

Documents are tokenised and cut where they are read; from then on only lengths move. Pieces are dealt into blocks of
bounded size. A block starts from its pieces in the order of arrival and is improved by moving pieces, exchanging one for
one and two for one between underfull bins, so that the sum of squared fills grows until bins run empty.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Store

#: Pieces of a block on average. More give a tighter packing, fewer a smaller task.
BLOCK = 16_000
#: Fixed value: where the tokenizers library splits a text for byte-level files.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same for texts of ASCII alone, which the standard library splits in half the time.
SPLIT_ASCII = re.compile(r" ?[A-Za-z]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
#: Characters whose class is the same in every version of Unicode that regex and tokenizers may have.
SETTLED = regex.compile("[\x00-\u0557\u2000-\u206f\u3040-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]*")
#: Split-off parts whose ids a process remembers.
REMEMBERED = 800_000
_ENCODERS: dict[str, Callable[[str], np.ndarray]] = {}


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """A function that gives the ids of tokenizers' encode(text, add_special_tokens=False).

    For byte-level files every part that the library would split off is encoded by the library's own model and
    remembered; texts with special tokens or unusual characters, and other files, go through encode itself.
    """
    if path not in _ENCODERS:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        direct = lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, "<u4")
        with open(path) as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec["normalizer"]
        plain = plain and model.get("type", "BPE") == "BPE" and not model.get("dropout") and not model.get("byte_fallback")
        special = [t.content for t in whole.get_added_tokens_decoder().values()]
        shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}  # these bytes stand for themselves in the file
        letters = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - shown))}

        class Parts(dict):
            def __missing__(self, part: str) -> bytes:
                if len(self) >= REMEMBERED:
                    self.clear()
                found = whole.model.tokenize(part.encode().decode("latin-1").translate(letters))
                ids = self[part] = np.array([t.id for t in found], "<u4").tobytes()
                return ids

        known = Parts()

        def encode(text: str) -> np.ndarray:
            ascii_ = text.isascii()
            if not plain or any(s in text for s in special) or not (ascii_ or SETTLED.fullmatch(text)):
                return direct(text)
            return np.frombuffer(b"".join(map(known.__getitem__, (SPLIT_ASCII if ascii_ else SPLIT).findall(text))), "<u4")

        _ENCODERS[path] = encode
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", end: int = 0, null_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the id `end`, cut into pieces of `capacity`
    ids if there are more; the first piece takes what is over."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs if null_ids else docs.where("doc_id is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column("doc_id").to_pylist()
            for k, text in enumerate(batch.column("text")):
                tokens = encode(text.as_py() or "")
                tokens = np.append(tokens, np.uint32(end))
                first = (len(tokens) - 1) % capacity + 1
                edges = [0, *range(first, len(tokens) + 1, capacity)]
                out += [(ids[k], n, a, b - a, zlib.crc32(tokens[a:b].tobytes())) for n, (a, b) in enumerate(zip(edges, edges[1:]))]
            c = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), *(pa.array(x, pa.int64()) for x in c[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def in_order(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices in the order of arrival: each piece into the last bin, or a new one if it has no room."""
    bins: list[list[int]] = []
    room = -1
    for i, n in enumerate(lengths.tolist()):
        if n > room:
            bins.append([])
            room = capacity
        bins[-1].append(i)
        room -= n
    return bins


class Pool:
    """Pieces of the bins that may still give, by size."""

    def __init__(self, capacity: int):
        self.sizes, self.by_size = 0, [set() for _ in range(capacity + 1)]  # bit n of sizes: there are pieces of size n

    def add(self, n: int, i: int) -> None:
        self.by_size[n].add(i)
        self.sizes |= 1 << n

    def take(self, n: int, i: int) -> None:
        self.by_size[n].discard(i)
        if not self.by_size[n]:
            self.sizes &= ~(1 << n)

    def largest(self, most: int) -> int:
        """The largest size up to `most`, 0 if none."""
        return max(0, (self.sizes & ((1 << (most + 1)) - 1)).bit_length() - 1)


def improve(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Local search over bins that aren't full. One after the other takes what fits best from those after it: by moves while
    a piece fits, then by exchanging one or two of its pieces for a larger one. Bins come by their largest piece in one
    turn, by their fill in the next. Every change makes the sum of squared fills grow, so the search ends: when the bins
    can't become fewer, or a turn of either kind changes nothing. Bins that run empty are dropped."""
    size = lengths.tolist()
    bins = [set(b) for b in bins]
    least = -(-sum(size) // capacity)
    idle, turn = 0, 0
    while idle < 2 and len(bins) > least:
        idle, turn = idle + 1, turn + 1
        order = (lambda b: -max(size[i] for i in bins[b])) if turn % 2 else (lambda b: -fill[b])
        home = {i: b for b, items in enumerate(bins) for i in items}
        fill = [sum(size[i] for i in b) for b in bins]
        pool = Pool(capacity)
        for b, items in enumerate(bins):
            if fill[b] < capacity:
                for i in items:
                    pool.add(size[i], i)
        queue = [(order(b), b) for b in range(len(bins)) if fill[b] < capacity]
        heapify(queue)
        while queue:
            f, to = heappop(queue)
            if not fill[to]:
                continue
            if f != order(to):  # it has given or been given pieces since
                heappush(queue, (order(to), to))
                continue
            for i in bins[to]:  # from here on it only takes
                pool.take(size[i], i)
            while fill[to] < capacity:
                slack = capacity - fill[to]
                n, out = pool.largest(slack), ()
                if not n:
                    by_size = {size[i]: i for i in bins[to]}
                    twins = {size[i]: i for i in bins[to] if by_size[size[i]] != i}
                    gain = 0
                    for y, i in by_size.items():
                        x = pool.largest(y + slack)
                        if x - y > gain:
                            gain, n, out = x - y, x, (i,)
                        for z, j in by_size.items() if gain < slack else ():
                            j = j if z < y else twins.get(y) if z == y else None
                            if j is not None and y + z < capacity:
                                x = pool.largest(min(y + z + slack, capacity))
                                if x - y - z > gain:
                                    gain, n, out = x - y - z, x, (i, j)
                        if gain == slack:
                            break
                    if not gain:
                        break
                rise = n - sum(size[j] for j in out)
                i = next(iter(pool.by_size[n]))
                if fill[to] + rise <= fill[home[i]]:  # squares would not rise; another piece of this size may do
                    i = min(pool.by_size[n], key=lambda i: fill[home[i]])
                    if fill[to] + rise <= fill[home[i]]:
                        break
                b = home[i]
                pool.take(n, i)
                bins[b].discard(i)
                bins[to].add(i)
                home[i] = to
                for j in out:
                    bins[to].discard(j)
                    bins[b].add(j)
                    home[j] = b
                    pool.add(size[j], j)
                    n -= size[j]
                fill[to] += n
                fill[b] -= n
                idle = 0
        bins = [b for b in bins if b]
    return [sorted(b) for b in bins]


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", null_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (its place there, gapless from 0).

    Null and empty texts are one piece, the end id alone. Rows with a null id give no row (with null_ids they are packed like others); rows that repeat an id are
    packed as documents of their own. Ties are broken by (doc_id, piece). Other columns are ignored; an empty table
    gives an empty result. Pieces that fill a sequence are one of their own (an odd sequence_id); blocks hold about `block` of the
    others by hash, however many there are, so each but a block's last bin is full or nearly so.
    """
    cut = Store(docs.sparkSession).save(pieces(docs, tokenizer, capacity, id_col, text_col, null_ids=null_ids))
    part = F.col("length") < capacity
    blocks = max(1, round(cut.where(part).count() / block))
    whole = cut.where(~part).select("*", (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.where(part).withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32"), F.lit(blocks)))

    def bins(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        length = t["length"].to_numpy()
        packed = improve(in_order(length, capacity), length, capacity)
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for s, b in enumerate(packed):
            sequence[b] = s
            offset[b] = np.cumsum(length[b]) - length[b]
        out = t.drop_columns(["block"])
        return out.append_column("sequence_id", pa.array(2 * (sequence * blocks + (t["block"][0].as_py() if len(length) else 0)))).append_column("offset", pa.array(offset))

    return rest.groupBy("block").applyInArrow(bins, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").unionByName(whole)
