"""Fill-in-middle transformation with a sparse exception index.

Texts stay UTF-8 bytes. Of a batch only the multibyte characters' places and their excess bytes are recorded; a cut in bytes
or in code points is converted by a binary search among them, and where there are none it is arithmetic.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernels as K
from ._store import lean

SENTINELS = ("<P>", "<S>", "<M>")


class Exceptions:
    """Multibyte characters of UTF-8 bytes: where they stand (in bytes and in code points) and the excess bytes up to each."""

    def __init__(self, data: np.ndarray):
        self.at_byte = np.flatnonzero(data >= 0xC0)
        lead = data[self.at_byte]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.excess = np.concatenate([[0], np.cumsum(excess)])
        self.at_char = self.at_byte - self.excess[:-1]

    def chars(self, byte: np.ndarray) -> np.ndarray:
        """Code points before places between characters that are given in bytes."""
        return byte - self.excess[np.searchsorted(self.at_byte, byte)]

    def bytes(self, char: np.ndarray) -> np.ndarray:
        """Bytes before places that are given in code points."""
        return char + self.excess[np.searchsorted(self.at_char, char)]


def unambiguous(sentinels: tuple[str, str, str]) -> None:
    """Raises unless the sentinels can be found again in any output whose parts hold none of them."""
    for a in sentinels:
        for b in sentinels:
            if not a or a is not b and a in b or any(a[-n:] == b[:n] for n in range(1, min(len(a), len(b)))):
                raise ValueError(f"sentinels may not be empty, contain or overlap each other: {sentinels}")
    if len(set(sentinels)) < 3:
        raise ValueError("sentinels must differ")


def unit_ends(data: np.ndarray, offsets: np.ndarray, unit: str, index: Exceptions) -> tuple[np.ndarray, np.ndarray]:
    """(ends, first): ends in bytes of all texts' units, and for each text where its own begin there.

    unit "token": a word with the white space before it, or white space at the end; "char": a code point.
    """
    if unit == "char":
        first = index.chars(offsets)
        return index.bytes(np.arange(1, first[-1] + 1)), first
    _, end, at = K.words(data, offsets)
    tail = np.flatnonzero((np.diff(offsets) > 0) & np.concatenate([K.SPACE[data], [False]])[np.maximum(offsets[1:], 1) - 1])
    return np.insert(end, at[tail + 1], offsets[tail + 1]), at + np.searchsorted(tail, np.arange(len(at)))


def fill_in_middle(docs: DataFrame, unit: str = "token", rate: int = 50, suffix_first: int = 80, seed: int = 42, sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars (code points; null if plain) and output.

    Draws are the sha256 of seed and id, so they don't depend on partitions: `rate` of 100 texts change their form,
    `suffix_first` of 100 of these to spm (suffix, prefix, middle), the others to psm (prefix, suffix, middle); two draws
    among 0..n give the cuts. Units are tokens (a word with the white space before it, or white space at the end) or code
    points. Empty texts and those that hold a sentinel are plain, null is empty. A null id draws like the empty string; rows that repeat an id
    draw alike. Other columns are ignored; an empty table gives an empty result.
    """
    unambiguous(sentinels)
    if unit not in ("token", "char"):
        raise ValueError(f"unknown unit: {unit}")
    lean(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), digest.alias("x"))
    h = [F.conv(F.substring("x", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    holds = F.col("text") == ""
    for s in sentinels:
        holds = holds | F.contains("text", F.lit(s))
    form = F.when(holds | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", form.alias("form"), h[0].alias("h1"), h[1].alias("h2"))
    key = dict(docs.dtypes)[id_col]
    pre, suf, mid = (s.encode() for s in sentinels)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.buffers(batch.column("text"))
            form = batch.column("form").to_pylist()
            h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
            for i, j in K.chunks(offsets):
                part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                index = Exceptions(part)
                ends, first = unit_ends(part, off, unit, index)
                n = np.diff(first)
                places = np.concatenate([ends, [0]])
                units = [h1[i:j] % (n + 1), h2[i:j] % (n + 1)]
                a, b = (np.where(k > 0, places[first[:-1] + np.maximum(k, 1) - 1], off[:-1]) for k in (np.minimum(*units), np.maximum(*units)))
                start, first_cut, second_cut = (index.chars(x) for x in (off[:-1], a, b))
                raw = part.tobytes()
                out = []
                for f, s, x, y, e in zip(form[i:j], off[:-1].tolist(), a.tolist(), b.tolist(), off[1:].tolist()):
                    if f == "plain":
                        out.append(raw[s:e])
                    elif f == "psm":
                        out.append(b"".join((pre, raw[s:x], suf, raw[y:e], mid, raw[x:y])))
                    else:
                        out.append(b"".join((suf, raw[y:e], pre, raw[s:x], mid, raw[x:y])))
                plain = np.array([f == "plain" for f in form[i:j]], bool)
                counts = [pa.array(c, pa.int64(), mask=plain) for c in (first_cut - start, second_cut - first_cut)]
                rows = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), rows.column("form"), *counts, pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(cut, f"doc_id {key}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """rows with `restored`, the text rebuilt from the columns output and form alone (null if either is)."""
    unambiguous(sentinels)
    part = "|".join(map(re.escape, sentinels))
    parts = F.when(F.col("form") != "plain", F.split("output", part, -1))
    p = [F.col("_parts").getItem(k) for k in range(4)]
    whole = F.when(F.col("form") == "plain", F.col("output")).when(F.col("form") == "psm", F.concat(p[1], p[3], p[2])).when(F.col("form") == "spm", F.concat(p[2], p[3], p[1]))
    return rows.withColumn("_parts", parts).withColumn("restored", whole).drop("_parts")
