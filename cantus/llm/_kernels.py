"""Numpy kernels on batches of texts: words, hashes, shingles, minimisers.

Two kinds of hashes. Those that say what is equal (words, shingles, windows, runs) mix their parts one after the other, and
long words and runs go through BLAKE2. Those that only choose a bucket (minimisers, cores) are polynomials modulo 2**64,
where a range's hash is a difference of prefix sums; equal ones of different content just share a bucket. Chunks are
bounded in bytes, whole documents stay together.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once (a longer document makes a chunk of its own).
CHUNK = 1 << 19
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Splits bits evenly over the 64-bit word."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def constants(seed: int, n: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=U) + U(seed << 20)) * U(0x9E3779B97F4A7C15)) | U(1)


BYTES = constants(1, 256)
LOWER = BYTES.copy()
LOWER[65:91] = BYTES[97:123]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASES = {"byte": (0x9E3779B97F4A7C15 | 1), "word": (0xD1342543DE82EF95 | 1), "other": (0xAF251AF3B0F025B5 | 1)}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if kind not in _POWERS or len(_POWERS[kind][0]) < n:
        size = max(n, CHUNK + 1)
        out = []
        for b in (_BASES[kind], pow(_BASES[kind], -1, 1 << 64)):
            p = np.full(size, U(b))
            p[0] = 1
            out.append(np.cumprod(p, dtype=U))
        _POWERS[kind] = tuple(out)
    return _POWERS[kind]


def prefix(values: np.ndarray, kind: str) -> np.ndarray:
    p = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(kind, len(values) + 1)[0][: len(values)], out=p[1:])
    return p


def ranges(p: np.ndarray, start: np.ndarray, end: np.ndarray, kind: str) -> np.ndarray:
    """Hashes of the ranges [start, end)."""
    return mix((p[end] - p[start]) * powers(kind, len(p))[1][start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's UTF-8 bytes and offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), o


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents whose texts together have about `most` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` in data, and for each document the index of its first word (n + 1 numbers). offsets start at 0."""
    inside = ~separators[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    o = offsets[:-1][offsets[:-1] < len(data)]
    first[o] = inside[o]
    o = offsets[1:][offsets[1:] > 0] - 1
    last[o] = inside[o]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: The first n bytes of a little-endian word of 8.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], U)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word: of up to 16 bytes mixed in two halves, of longer ones by BLAKE2. Seeds give independent hashes."""
    text = FOLD[data] if lower else data
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    lanes = np.ndarray(len(text) + 9, np.dtype("<u8"), padded.data, strides=(1,))
    n = end - start
    c = constants(21 + seed, 4)
    h = mix((lanes[start] & _FIRST[np.minimum(n, 8)]) ^ c[0])
    if len(n) and n.max() > 8:
        more = np.flatnonzero(n > 8)
        h[more] = mix(h[more] * c[1] + mix((lanes[start[more] + 8] & _FIRST[np.minimum(n[more] - 8, 8)]) ^ c[2]))
    h = mix(h * c[3] ^ n.astype(U))
    long = np.flatnonzero(n > 16)
    if len(long):
        raw = text.tobytes()
        salt = bytes([seed])
        h[long] = np.frombuffer(b"".join(blake2b(raw[a:b], digest_size=8, salt=salt).digest() for a, b in zip(start[long].tolist(), end[long].tolist())), U)
    return h


def chained(h: np.ndarray, start: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash of the `size` values of h from each start, mixed one after the other."""
    c = constants(31 + seed, 2)
    return chained_from(np.full(len(start), c[0]), h, start, size, c[1])


def digests(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit BLAKE2 digests of the ranges, as rows of two numbers."""
    return np.frombuffer(b"".join(blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist())), np.int64).reshape(-1, 2)


def single_spaced(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space after each, and their starts and ends there."""
    size = end - start + 1
    at = np.cumsum(size) - size
    where = np.arange(int(size.sum())) + np.repeat(start - at, size)
    out = np.concatenate([data, np.zeros(1, np.uint8)])[where]
    out[at + size - 1] = 0x20
    return out, at, at + size - 1


def shingles(h: np.ndarray, at: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every document's runs of `size` words (all words as one if it has fewer), and where each document's begin."""
    n = np.diff(at)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    to = np.concatenate([[0], np.cumsum(count)])
    start = np.arange(to[-1]) - np.repeat(to[:-1] - at[:-1], count)
    words = np.repeat(np.minimum(n, size), count)
    c = constants(41, 2)
    out = mix(words.astype(U) * c[0])
    padded = np.concatenate([h, np.zeros(size, U)])
    full = chained_from(out, padded, start, size, c[1])
    short = np.flatnonzero(words < size)
    if len(short):
        some = out[short]
        for j in range(size - 1):
            some = np.where(j < words[short], mix(some * c[1] ^ padded[start[short] + j]), some)
        full[short] = some
    return full, to


def chained_from(out: np.ndarray, h: np.ndarray, start: np.ndarray, size: int, odd: np.uint64) -> np.ndarray:
    for j in range(size):
        out = mix(out * odd ^ h[start + j])
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


#: Bits of a minimiser's place; what is left of its hash orders it. Fixed, so that every chunk orders alike.
_PLACE = U(31)


def segments(unit: np.ndarray, at: np.ndarray, window: int, gram: int, kind: str) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows (of `window` units, within one document) that share their minimiser, the run of
    `gram` units with the least hash, the leftmost of equal ones.

    unit: a hash for each unit; at: where documents begin. Returns for each run its document, the first window's start
    (in the document), the number of windows, the minimiser's place after that start and the minimiser's hash.
    """
    none = np.zeros(0, np.int64)
    n = len(unit)
    if n < window:
        return none, none, none, none, none.astype(U)
    p = prefix(unit, kind)
    g = n - gram + 1
    i = np.arange(g)
    anchor = ranges(p, i, i + gram, kind)
    least = sliding_min(((anchor >> _PLACE) << _PLACE) | i.astype(U), window - gram + 1)
    least = (least & ((U(1) << _PLACE) - U(1))).astype(np.int64)  # where each window's minimiser stands
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    ok = doc[: n - window + 1] == doc[window - 1 :]
    begin = ok.copy()
    begin[1:] &= (least[1:] != least[:-1]) | ~ok[:-1] | (doc[1 : n - window + 1] != doc[: n - window])
    s = np.flatnonzero(begin)
    after = np.concatenate([begin[1:] | ~ok[1:], [True]]) & ok
    e = np.flatnonzero(after)  # last window
    m = least[s]
    return doc[s], s - at[doc[s]], e - s + 1, m - s, anchor[m]


def union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the given ranges (touching ranges join)."""
    if not len(starts):
        return starts, ends
    o = np.argsort(starts, kind="stable")
    starts, ends = starts[o], np.maximum.accumulate(ends[o])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    k = np.flatnonzero(new)
    return starts[k], ends[np.concatenate([k[1:] - 1, [len(ends) - 1]])]


def kept_bytes(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """Texts from the bytes that are kept."""
    at = np.concatenate([[0], np.cumsum(keep)])[offsets]
    out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[keep]))])
    return out.cast(pa.binary()).cast(kind or pa.string())


def joined(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray, keep: np.ndarray) -> pa.Array:
    """Each document's kept words, joined by one space."""
    k = np.flatnonzero(keep)
    doc = np.searchsorted(at, k, "right")
    more = np.concatenate([doc[1:] == doc[:-1], [False]]) if len(k) else np.zeros(0, bool)
    data = data.copy()
    data[end[k[more]]] = 0x20
    step = np.zeros(len(data) + 1, np.int8)
    step[start[k]] += 1
    np.add.at(step, end[k] + more, -1)
    return kept_bytes(data, offsets, np.cumsum(step[:-1]).astype(bool))
