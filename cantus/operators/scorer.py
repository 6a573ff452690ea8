"""Scores of token sequences by a pluggable scorer, in Arrow batches; what they feed is tokens.ensemble."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens


class TokenScorer(Protocol):
    """Anything with a number of classes and a score for each class of every token. A trained network fits in here."""

    classes: int

    def score(self, fields: np.ndarray) -> np.ndarray:
        """(n, 4) ids of bar, position, pitch and duration to (n, classes)."""
        ...


@dataclass(frozen=True)
class LinearScorer:
    """A weight for each class and field, and a bias."""

    weights: tuple[tuple[float, ...], ...]
    bias: tuple[float, ...]

    @property
    def classes(self) -> int:
        return len(self.bias)

    def score(self, fields: np.ndarray) -> np.ndarray:
        return fields @ np.array(self.weights).T + np.array(self.bias)


def scored(words: DataFrame, scorer: TokenScorer, run: int = 0, offset: int = 0, length: int = tokens.LENGTH) -> DataFrame:
    """(piece_id, w, run, chunk, s0 .. ) of encoded words (piece_id, w, t_bar, t_position, t_pitch, t_duration)."""
    names = [f"s{k}" for k in range(scorer.classes)]
    chunked = tokens.chunks(words, offset, length).select("piece_id", F.col("w").cast("long").alias("w"), F.lit(run).alias("run"), F.col("chunk").cast("long").alias("chunk"), "t_bar", "t_position", "t_pitch", "t_duration")

    def run_scorer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[["piece_id", "w", "run", "chunk"]].copy()
            out[names] = scorer.score(pdf[["t_bar", "t_position", "t_pitch", "t_duration"]].to_numpy(float)) if len(pdf) else 0.0
            yield out

    piece = chunked.schema["piece_id"].dataType.simpleString()
    return chunked.mapInPandas(run_scorer, f"piece_id {piece}, w long, run int, chunk long, " + ", ".join(f"{n} double" for n in names))


def melody(words: DataFrame, scorers: list[TokenScorer], positive: tuple[int, ...] = (1, 2), length: int = tokens.LENGTH) -> DataFrame:
    """The words that an ensemble of scorers calls melody, as notes (piece_id, w, onset, pitch, duration)."""
    scores = scored(words, scorers[0], 0, 0, length)
    for k, s in enumerate(scorers[1:], 1):
        scores = scores.unionByName(scored(words, s, k, 0, length))
    found = tokens.ensemble(scores, scorers[0].classes, positive).where(F.col("predicted").isin(*positive)).select("piece_id", "w")
    return tokens.decode(words).join(found, ["piece_id", "w"], "left_semi")
