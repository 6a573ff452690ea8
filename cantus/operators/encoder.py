"""Learned segment vectors: a small transformer encoder, run in numpy on Arrow batches with weights sent to the tasks once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Weights = dict[str, np.ndarray]


def random_weights(inputs: int = 2, width: int = 32, heads: int = 4, layers: int = 2, seed: int = 0) -> Weights:
    """Weights of the right shapes, for tests and as a start of training elsewhere. Files of the same arrays (.npz) are read by numpy.load."""
    r = np.random.default_rng(seed)
    w: Weights = {"heads": np.array(heads), "layers": np.array(layers), "in.w": r.normal(size=(inputs, width)) / np.sqrt(inputs), "in.b": np.zeros(width), "out.w": r.normal(size=(width, width)) / np.sqrt(width), "out.b": np.zeros(width)}
    for k in range(layers):
        for name, shape in (("q", (width, width)), ("k", (width, width)), ("v", (width, width)), ("o", (width, width)), ("f1", (width, 4 * width)), ("f2", (4 * width, width))):
            w[f"{k}.{name}.w"] = r.normal(size=shape) / np.sqrt(shape[0])
            w[f"{k}.{name}.b"] = np.zeros(shape[1])
        for n in ("n1", "n2"):
            w[f"{k}.{n}.w"], w[f"{k}.{n}.b"] = np.ones(width), np.zeros(width)
    return w


def _norm(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5) * w + b


def positions(n: int, width: int) -> np.ndarray:
    angle = np.arange(n)[:, None] / 10000 ** (np.arange(0, width, 2) / width)
    out = np.zeros((n, width))
    out[:, 0::2], out[:, 1::2] = np.sin(angle), np.cos(angle[:, : width // 2])
    return out


def encode(x: np.ndarray, mask: np.ndarray, w: Weights) -> np.ndarray:
    """x (batch, time, inputs), mask (batch, time) to unit vectors (batch, width): layers of attention and a feed-forward part, each
    normalised after its sum, then the mean over unmasked steps."""

    def linear(v: np.ndarray, name: str) -> np.ndarray:
        return v @ w[f"{name}.w"] + w[f"{name}.b"]

    heads, n = int(w["heads"]), x.shape[1]
    h = linear(x, "in") + positions(n, w["in.w"].shape[1])
    for k in range(int(w["layers"])):
        q, key, v = (linear(h, f"{k}.{c}").reshape(len(x), n, heads, -1).transpose(0, 2, 1, 3) for c in "qkv")
        score = np.where(mask[:, None, None, :], q @ key.transpose(0, 1, 3, 2) / np.sqrt(q.shape[-1]), -1e9)
        score = np.exp(score - score.max(-1, keepdims=True))
        score /= score.sum(-1, keepdims=True)
        h = _norm(h + linear((score @ v).transpose(0, 2, 1, 3).reshape(len(x), n, -1), f"{k}.o"), w[f"{k}.n1.w"], w[f"{k}.n1.b"])
        h = _norm(h + linear(np.maximum(linear(h, f"{k}.f1"), 0), f"{k}.f2"), w[f"{k}.n2.w"], w[f"{k}.n2.b"])
    mean = (h * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1), 1)[:, None]
    out = linear(mean, "out")
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where((mask.sum(1) > 0)[:, None], out / np.maximum(length, 1e-9), 0)


def segment_vectors(stepped: DataFrame, weights: Weights, longest: int = 256) -> DataFrame:
    """Steps (piece_id, seg, i, d_pitch, d_time) to (piece_id, seg, vector): sequences of up to `longest` steps, the model's input length."""
    rows = stepped.groupBy("piece_id", "seg").agg(F.slice(F.sort_array(F.collect_list(F.struct("i", "d_pitch", "d_time"))), 1, longest).alias("s"))
    rows = rows.select("piece_id", "seg", F.transform("s", lambda s: s["d_pitch"].cast("double")).alias("p"), F.transform("s", lambda s: s["d_time"]).alias("t"))
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 128):
                part = pdf.iloc[a : a + 128]
                n = part.p.map(len).to_numpy()
                x = np.zeros((len(part), max(1, n.max()), 2))
                for k, (p, t) in enumerate(zip(part.p, part.t)):
                    x[k, : n[k], 0], x[k, : n[k], 1] = p, t
                out = encode(x, np.arange(x.shape[1])[None, :] < n[:, None], shared.value)
                yield pd.DataFrame({"piece_id": part.piece_id.to_numpy(), "seg": part.seg.to_numpy(), "vector": list(out.astype(np.float32))})

    kinds = dict(rows.dtypes)
    return rows.mapInPandas(run, f"piece_id {kinds['piece_id']}, seg {kinds['seg']}, vector array<float>")


def read_weights(path: str) -> Weights:
    """Weights from a .npz file of the arrays that random_weights names."""
    with np.load(path) as f:
        return {k: f[k] for k in f.files}
