"""Token counts: batch encoding in Arrow functions that return lengths only.

Long texts are split where no token can reach across. Fragments are gathered into batches of about the same number of
bytes, whatever the texts' lengths, and the library encodes a batch at a time; only lengths leave a task. For
byte-level files the fragments are split further, at every place where the library's own splitting must end a part, so that each
different part is encoded once by a task and its length remembered.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import lean
from .packing import SETTLED, SPLIT, SPLIT_ASCII

#: Bytes of a batch for the library, and characters beyond which a text is split.
BATCH, LONG = 1 << 18, 1 << 16
#: Different parts whose lengths a process remembers.
REMEMBERED = 1_000_000
#: Where byte-level splitting must end a part, whatever stands around: after a letter or digit, before ASCII space or a mark.
SAFE = re.compile(r"[0-9A-Za-z一-龥ぁ-ゖァ-ヺ가-힣](?=[\t-\r -/:-@\[-`{-~、。，])")
#: Where pieces of a sentence-piece model that hold no inner space must end: a single space between words. It is left out.
SAFE_SPACE = re.compile(r"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")


def fragments(text: str, safe: re.Pattern, special: list[str], most: int = LONG, skip: int = 0) -> list[str]:
    """text in parts of about `most` characters, cut at the first safe place from there, but never within a string of
    `special`. skip: characters left out at a cut. A text without a safe place stays whole."""
    if len(text) <= most:
        return [text]
    barred = sorted((m.start(), m.end()) for s in special for m in re.finditer(f"(?={re.escape(s)})", text))
    barred = [(a, a + len(s)) for s in special for a, _ in barred if text.startswith(s, a)]
    out, begin = [], 0
    while len(text) - begin > most:
        found = safe.search(text, begin + most - 1)
        while found and any(a < found.end() - skip < b for a, b in barred):
            found = safe.search(text, found.start() + 1)
        if not found:
            break
        cut = found.end() - skip
        out.append(text[begin:cut])
        begin = cut + skip
    return [*out, text[begin:]]


def balanced(texts: list[str], most: int = BATCH) -> Iterator[list[str]]:
    """texts in order, in batches of about `most` bytes."""
    batch, size = [], 0
    for t in texts:
        batch.append(t)
        size += len(t) if t.isascii() else 4 * len(t)
        if size >= most:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def byte_level(spec: dict) -> bool:
    """Does this file split texts by the byte-level pattern, without changing them before?"""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
    plain = plain and model.get("type", "BPE") == "BPE" and not model.get("dropout") and not spec.get("truncation") and not spec.get("padding")
    return bool(plain) and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", []))


def _tokenizers(path: str) -> Callable[[list[str]], np.ndarray]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    with open(path) as f:
        plain = byte_level(json.load(f))
    special = [t.content for t in library.get_added_tokens_decoder().values()]
    known: dict[str, int] = {}

    def encoded(texts: list[str]) -> list[int]:
        return [len(e) for batch in balanced(texts) for e in library.encode_batch_fast(batch, add_special_tokens=False)]

    def lengths(texts: list[str]) -> np.ndarray:
        if not plain:
            return np.array(encoded(texts), np.int64)
        if len(known) >= REMEMBERED:
            known.clear()
        whole, owner = [], []  # fragments that the library splits itself
        parts: list[tuple[int, list[str]]] = []
        for k, text in enumerate(texts):
            for t in fragments(text, SAFE, special):
                if any(s in t for s in special) or not (t.isascii() or SETTLED.fullmatch(t)):
                    whole.append(t)
                    owner.append(k)
                else:
                    parts.append((k, (SPLIT_ASCII if t.isascii() else SPLIT).findall(t)))
        new = list({p for _, found in parts for p in found if p not in known})
        known.update(zip(new, encoded(new)))
        out = np.zeros(len(texts), np.int64)
        for k, found in parts:
            out[k] += sum(map(known.__getitem__, found))
        np.add.at(out, np.array(owner, np.int64), np.array(encoded(whole), np.int64))
        return out

    return lengths


def _sentencepiece(path: str) -> Callable[[list[str]], np.ndarray]:
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    mark = "▁"
    inner = any(mark in p.strip(mark) or p.endswith(mark) and p.strip(mark) for p in map(library.id_to_piece, range(library.get_piece_size())))
    dummy = library.encode("a b", out_type=str) == library.encode("a", out_type=str) + library.encode("b", out_type=str)

    def lengths(texts: list[str]) -> np.ndarray:
        split = [fragments(t, SAFE_SPACE, [], skip=1) if dummy and not inner else [t] for t in texts]
        flat = [t for ts in split for t in ts]
        found = [len(ids) for batch in balanced(flat) for ids in library.encode(batch, num_threads=1)]
        return np.add.reduceat(np.array(found, np.int64), np.cumsum([0] + [len(ts) for ts in split[:-1]])) if texts else np.zeros(0, np.int64)

    return lengths


_COUNTERS: dict[str, Callable[[list[str]], np.ndarray]] = {}


def counter(path: str) -> Callable[[list[str]], np.ndarray]:
    """A function that gives the number of tokens of each text, as the file's library (tokenizers for .json, sentencepiece for .model) does."""
    if path not in _COUNTERS:
        if not path.endswith((".json", ".model")):
            raise ValueError(f"neither .json nor .model: {path}")
        _COUNTERS[path] = (_tokenizers if path.endswith(".json") else _sentencepiece)(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs but the text, and n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Tokens are those of the library's defaults without begin, end or added special tokens, and without truncation or padding; a
    special token's string within a text is handled as the library does by default. Null and empty texts have none. Null ids and rows that repeat an id
    are counted like others. Columns of docs with the new names are replaced; an empty table gives an empty result. The file must be on every executor
    under the same path. Texts of over `LONG` characters are split for byte-level files and for sentence-piece models whose pieces hold no inner space; other files get them whole.
    """
    lean(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (text_col, "n_bytes", "n_tokens", "over_limit")]
    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = counter(tokenizer)
        for batch in batches:
            size = batch.column("n_bytes").to_numpy()
            edges = np.flatnonzero(np.diff(np.cumsum(size) // BATCH, prepend=-1))  # texts of about BATCH bytes at once
            n = [lengths(batch.column("_text").slice(a, b - a).to_pylist()) for a, b in zip(edges, [*edges[1:], batch.num_rows])]
            out = np.concatenate([*n, np.zeros(0, np.int64)])
            kept = [batch.column(c) for c in [*keep, "n_bytes"]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.int64())], names=[*keep, "n_bytes", "n_tokens"])

    kinds = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in keep)
    out = rows.mapInArrow(count, f"{kinds}{', ' if kinds else ''}n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
