"""Preparation of training and its sums: batches with positives, variants of sequences, masking plans, losses, and the fit of a linear scorer.

Draws are hashes of a seed and a row's own keys, so they are the same on every partitioning and need no shuffle. Sums over
pairs or rows are partial aggregates; what travels between rounds is a model's weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import unit
from . import tokens
from .graph import dropped, written
from .scorer import LinearScorer

#: Rows of one label that a window ranks, and rows on each side of a block of pairs.
RANKED, BLOCK = 1 << 16, 1024


def digest(seed: int, *keys: Column | str) -> Column:
    """64 hexadecimal digits of seed and keys."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys)), 256)


def draw(hexes: Column, k: int = 0) -> Column:
    """The kth of eight unsigned 32-bit numbers of a digest."""
    return F.conv(F.substring(hexes, 8 * k + 1, 8), 16, 10).cast("long")


def uniform(hexes: Column, k: int = 0) -> Column:
    """A number above 0 and below 1."""
    return (draw(hexes, k) + 0.5) / float(1 << 32)


def contrastive_batches(rows: DataFrame, size: int, seed: int = 1, id_col: str = "id", label_col: str = "label", ranked: int = RANKED, digits: int = 3) -> DataFrame:
    """rows (ids are distinct) with batch and place: batches of about `size` rows, at least two of each label in them. Rows of a label that has only one, or of none,
    can have no positive: their batch is null.

    Rows of a label are paired in the order of hashes, an odd one joins a pair; pairs are dealt in the order of their own
    hashes, size / 2 to a batch. A label of many rows is ranked in parts of about `ranked`; pairs are ranked within the first `digits`
    digits of their hash and the parts' counts are added up, so nothing is sorted as a whole.
    """
    named = rows.where(F.col(label_col).isNotNull())
    n = named.groupBy(label_col).agg(F.ceil(F.count(F.lit(1)) / ranked).alias("_parts"))
    x = named.select(F.col(id_col).alias("_id"), label_col).join(n, label_col).withColumn("_part", draw(digest(seed, F.lit("part"), "_id")) % F.col("_parts"))
    part = Window.partitionBy(label_col, "_part")
    order = (digest(seed, F.lit("row"), "_id"), "_id")
    x = x.withColumn("_n", F.count(F.lit(1)).over(part)).withColumn("_r", F.row_number().over(part.orderBy(*order)) - 1)
    paired = x.where("_n > 1").select("_id", label_col, "_part", F.least(F.floor(F.col("_r") / 2), F.floor(F.col("_n") / 2) - 1).alias("_pair"))
    # Rows alone in their part: two of a label or more make pairs, one alone joins the first pair of its label.
    own = Window.partitionBy(label_col)
    alone = x.where("_n = 1").withColumn("_n", F.count(F.lit(1)).over(own)).withColumn("_r", F.row_number().over(own.orderBy(*order)) - 1)
    some = paired.groupBy(label_col).agg(F.min("_part").alias("_first"))
    alone = alone.join(some, label_col, "left").where("_n > 1 or _first is not null")
    joined = F.col("_n") == 1
    alone = alone.select("_id", label_col, F.when(joined, F.col("_first")).otherwise(-1).alias("_part"), F.when(joined, 0).otherwise(F.least(F.floor(F.col("_r") / 2), F.floor(F.col("_n") / 2) - 1)).alias("_pair"))
    paired = paired.unionByName(alone).withColumn("_hash", digest(seed, F.lit("pair"), label_col, "_part", "_pair"))
    pairs = paired.select("_hash").distinct().withColumn("_head", F.substring("_hash", 1, digits))
    heads = pairs.groupBy("_head").agg(F.count(F.lit(1)).alias("_k")).withColumn("_before", F.coalesce(F.sum("_k").over(Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_head").orderBy("_hash")) - 1
    dealt = pairs.join(heads, "_head").select("_hash", place.alias("_place"))
    batch = F.floor(F.col("_place") / (size // 2))
    out = paired.join(dealt, "_hash").select("_id", batch.alias("batch"), (F.row_number().over(Window.partitionBy(batch).orderBy("_place", "_id")) - 1).alias("place"))
    return rows.drop("batch", "place").join(out, F.col(id_col) == F.col("_id"), "left").drop("_id")


def augmented(steps: DataFrame, variants: int, tempo: tuple[float, float] | None = None, jitter: float = 0.0, drop: float = 0.0, seed: int = 1) -> DataFrame:
    """steps (piece_id, seg, i, d_time, ..) once for each variant: the log time of a sequence moved by the log of a tempo factor drawn between both bounds, of each step by a normal
    draw of deviation `jitter`; a step goes with probability `drop`, but the one with the largest draw of its sequence stays."""
    out = steps.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    own, each = digest(seed, F.lit("tempo"), "variant", "piece_id", "seg"), digest(seed, F.lit("step"), "variant", "piece_id", "seg", "i")
    time = F.col("d_time")
    if tempo:
        time = time + F.log(F.greatest(tempo[0] + (tempo[1] - tempo[0]) * uniform(own), F.lit(1e-4)))
    if jitter:
        time = time + jitter * F.sqrt(-2 * F.log(uniform(each))) * F.cos(2 * math.pi * uniform(each, 1))
    out = out.withColumn("d_time", time)
    if drop:
        u = uniform(each, 2)
        last = F.row_number().over(Window.partitionBy("variant", "piece_id", "seg").orderBy(F.desc("_u"), "i"))
        out = out.withColumn("_u", u).withColumn("_k", last).where((F.col("_u") > drop) | (F.col("_k") == 1)).drop("_u", "_k")
    return out


#: The last two ids of a field's vocabulary: padding and mask.
SIZES = (tokens.BAR, tokens.POSITION, tokens.PITCH, tokens.DURATION)
FIELDS = ("t_bar", "t_position", "t_pitch", "t_duration")


def places(chunked: DataFrame, length: int = tokens.LENGTH) -> DataFrame:
    """All places of every chunk: (piece_id, chunk, pos and the four fields), padding where there is no word."""
    every = chunked.select("piece_id", "chunk").distinct().withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long"))))
    words = chunked.select("piece_id", "chunk", F.col("pos").cast("long").alias("pos"), *FIELDS)
    return every.join(words, ["piece_id", "chunk", "pos"], "left").select("piece_id", "chunk", "pos", *(F.coalesce(f, F.lit(n - 2)).cast("int").alias(f) for f, n in zip(FIELDS, SIZES)))


def masked(rows: DataFrame, share: float = 0.15, length: int = tokens.LENGTH, seed: int = 1) -> DataFrame:
    """rows (piece_id, chunk, pos and the four fields) with plan and the fields as a model gets them (m_bar, ..).

    Of the `length` places of a chunk exactly round(length * share) are planned: 80 % of them `mask`, 10 % `random`, the others `keep`; plan is null elsewhere.
    A place's rank comes from a permutation of 0 .. length - 1 that is keyed by seed and chunk, so a row decides for itself and nothing is shuffled. length must be a power of two.
    """
    bits = length.bit_length() - 1
    if length != 1 << bits or length < 4:
        raise ValueError(f"length must be a power of two: {length}")
    n = round(length * share)
    n_mask, n_random = round(n * 0.8), round(n * 0.1)
    rows = rows.withColumn("_key", digest(seed, F.lit("chunk"), "piece_id", "chunk"))
    x = F.col("pos").cast("long").bitwiseXOR(draw(F.col("_key")) % length)
    for k in (1, 3, 5):  # an odd factor, a shift and a fold are one to one each
        x = ((x * (2 * (draw(F.col("_key"), k) % (length // 2)) + 1) + draw(F.col("_key"), k + 1)) % length)
        x = x.bitwiseXOR(F.shiftright(x, bits // 2)) if k < 5 else x
    rank = F.col("_rank")
    plan = F.when(rank < n_mask, "mask").when(rank < n_mask + n_random, "random").when(rank < n, "keep")
    rows = rows.withColumn("_rank", x).withColumn("plan", plan).withColumn("_word", F.when(F.col("plan") == "random", digest(seed, F.lit("word"), "piece_id", "chunk", "pos")))
    fields = [F.when(F.col("plan") == "mask", size - 1).when(F.col("plan") == "random", draw(F.col("_word"), k) % size).otherwise(F.col(f)).cast("int").alias(f.replace("t_", "m_")) for k, (f, size) in enumerate(zip(FIELDS, SIZES))]
    return rows.select("*", *fields).drop("_key", "_rank", "_word")


def token_loss(rows: DataFrame, scores: Sequence[str], target: Column, weights: Sequence[float], mask: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, loss): weighted cross-entropy of a target class from scores, summed over the rows that mask says and divided by their number. Rows without a target or mask don't count; a
    group without rows that count has a null loss."""
    best = F.greatest(*scores) if len(scores) > 1 else F.col(scores[0])
    total = best + F.log(sum((F.exp(F.col(s) - best) for s in scores[1:]), F.exp(F.col(scores[0]) - best)))
    at = lambda values: F.element_at(F.array(*values), (target + 1).cast("int"))
    loss = at([F.lit(float(w)) for w in weights]) * (total - at([F.col(s) for s in scores]))
    counts = target.isNotNull() & (F.lit(True) if mask is None else F.coalesce(mask, F.lit(False)))
    x = rows.withColumn("_loss", F.when(counts, loss))
    out = [F.count("_loss").alias("n"), (F.sum("_loss") / F.nullif(F.count("_loss"), F.lit(0))).alias("loss")]
    return x.groupBy(*by).agg(*out) if by else x.agg(*out)


def contrastive_loss(rows: DataFrame, temperature: float, batch: str | None = "batch", block: int = BLOCK, id_col: str = "id", label_col: str = "label", vector_col: str = "vector") -> DataFrame:
    """(batch, n, n_valid, loss): for each row with another of its label in the batch the mean, over those, of the log-softmax of their
    similarity among all others (cosine over temperature), negated; the mean over such rows. No batch column: all rows are one.

    Rows without a batch, label or vector are left out; a vector of no length has similarity 0 to all. Pairs of a batch are formed in blocks of
    `block` rows; a row's sum of exponentials in a block travels as its largest exponent and a scaled sum, which add up in any order, so a batch of any size
    is spread over tasks. The result is quadratic in a batch by its definition.
    """
    group = F.col(batch) if batch else F.lit(0)
    x = rows.select(group.alias("batch"), F.col(id_col).cast("string").alias("id"), F.col(label_col).cast("string").alias("label"), unit(F.col(vector_col)).alias("v")).dropna()
    blocks = x.groupBy("batch").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = x.join(blocks, "batch").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sides = dealt.select("batch", F.col("own").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"), "id", "label", "v").unionByName(dealt.select("batch", F.col("other").alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "id", "label", "v"))

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if not len(a) or not len(b):
            return pdf.iloc[:0][["batch", "id"]].assign(top=0.0, scaled=0.0, same=0.0, n_same=0)
        sim = np.stack(a.v.to_numpy()) @ np.stack(b.v.to_numpy()).T / temperature
        self_ = a.id.to_numpy()[:, None] == b.id.to_numpy()[None, :]
        same = (a.label.to_numpy()[:, None] == b.label.to_numpy()[None, :]) & ~self_
        masked_sim = np.where(self_, -np.inf, sim)
        top = masked_sim.max(axis=1)
        scaled = np.exp(masked_sim - np.where(np.isfinite(top), top, 0)[:, None]).sum(axis=1)
        return pd.DataFrame({"batch": a.batch.to_numpy(), "id": a.id.to_numpy(), "top": np.where(np.isfinite(top), top, -1e300), "scaled": scaled, "same": (sim * same).sum(axis=1), "n_same": same.sum(axis=1)})

    kind = dict(x.dtypes)["batch"]
    parts = sides.groupBy("batch", "i", "j").applyInPandas(pairs, f"batch {kind}, id string, top double, scaled double, same double, n_same long")
    each = parts.groupBy("batch", "id").agg(F.max("top").alias("top"), F.collect_list(F.struct("top", "scaled")).alias("p"), F.sum("same").alias("same"), F.sum("n_same").alias("n_same"))
    scaled = F.aggregate("p", F.lit(0.0), lambda s, y: s + y["scaled"] * F.exp(y["top"] - F.col("top")))
    total = F.col("top") + F.log(scaled + 1e-9 * F.exp(-F.col("top")))
    loss = F.when(F.col("n_same") > 0, total - F.col("same") / F.col("n_same"))
    return each.withColumn("_loss", loss).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.count("_loss").alias("n_valid"), F.avg("_loss").alias("loss"))


@dataclass(frozen=True)
class Fit:
    """A fold's scorer, the validation F1 of every round, and which round was best."""

    fold: int
    scorer: LinearScorer
    f1: tuple[float, ...]
    best: int


def fit(words: DataFrame, classes: int = 4, folds: int = 5, rounds: int = 20, patience: int = 5, rate: float = 1.0, decay: float = 0.01, weights: Sequence[float] = (1.0, 2.0, 1.0, 1.0), positive: Sequence[int] = (1, 2)) -> list[Fit]:
    """Linear scorers of token classes for all folds at once, by gradient descent on the weighted cross-entropy over the whole table.

    words: (fold, label, t_bar, t_position, t_pitch, t_duration), label from 0. Fold k is fitted on all words but those of folds k and k + 1, the latter validates. A round
    sends the weights to all tasks; each sends one row of sums for each fold and batch, which Spark adds up. A fold's scorer is that of the round with the best F1 of the positive
    classes on its validation words (the first of equal ones); rounds end when no fold has become better for `patience` of them. Words without a fold or label don't count.
    """
    rows = written(words.where("fold is not null and label is not null").select(F.col("fold").cast("int").alias("fold"), F.col("label").cast("int").alias("label"), *(F.col(f).cast("double").alias(f) for f in FIELDS)))
    scale = np.array([1 / n for n in SIZES] + [1.0])
    n_in = len(scale)
    w = np.zeros((folds, classes, n_in))
    cost = np.array(weights, float)
    names = [f"g{i}" for i in range(classes * n_in)]
    seen: list[list[float]] = [[] for _ in range(folds)]
    best = [w[k] for k in range(folds)]
    for _ in range(rounds):
        now = w.copy()

        def sums(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = np.stack([*(b.column(f).to_numpy() for f in FIELDS), np.ones(b.num_rows)], 1) * scale
                fold, label = b.column("fold").to_numpy(), b.column("label").to_numpy()
                out = []
                for k in range(folds):
                    s = x @ now[k].T
                    train, valid = (fold != k) & (fold != (k + 1) % folds), fold == (k + 1) % folds
                    p = np.exp(s - s.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    p[np.arange(len(label)), label] -= 1
                    c = cost[label] * train
                    g = (p * c[:, None]).T @ x
                    found, true = np.isin(s.argmax(axis=1), positive) & valid, np.isin(label, positive) & valid
                    out.append([k, *g.ravel().tolist(), float(c.sum()), float((found & true).sum()), float((found | true).sum() - (found & true).sum())])
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[i] for r in out], pa.float64()) for i in range(1, len(out[0])))], names=["k", *names, "cost", "both", "either"])

        kinds = ", ".join(f"{n} double" for n in [*names, "cost", "both", "either"])
        got = rows.mapInArrow(sums, f"k int, {kinds}").groupBy("k").agg(*(F.sum(n).alias(n) for n in [*names, "cost", "both", "either"])).collect()
        for r in got:
            k = r.k
            f1 = 2 * r.both / (2 * r.both + r.either) if r.both else 0.0
            if not seen[k] or f1 > max(seen[k]):
                best[k] = now[k]
            seen[k].append(f1)
            if r.cost:
                w[k] = w[k] - rate * (np.array([r[n] for n in names]).reshape(classes, n_in) / r.cost + decay * w[k])
        if not got or all(len(s) - 1 - int(np.argmax(s)) >= patience for s in seen if s):
            break
    dropped(rows)
    return [Fit(k, LinearScorer(tuple(map(tuple, (best[k][:, :-1] * scale[:-1]).tolist())), tuple(best[k][:, -1].tolist())), tuple(seen[k]), int(np.argmax(seen[k])) if seen[k] else 0) for k in range(folds)]


def fold_f1(words: DataFrame, fits: Sequence[Fit], positive: Sequence[int] = (1, 2)) -> DataFrame:
    """(fold, tp, fp, fn, f1) of each fold's scorer on the fold's own words, as columns of expressions."""
    best = None
    for f in fits:
        scores = [sum((F.col(c) * v for c, v in zip(FIELDS, row)), F.lit(b)) for row, b in zip(f.scorer.weights, f.scorer.bias)]
        values = F.array(*scores)
        found = F.array_position(values, F.array_max(values)) - 1
        best = F.when(F.col("fold") == f.fold, found) if best is None else best.when(F.col("fold") == f.fold, found)
    x = words.where("fold is not null and label is not null").select("fold", best.isin(*positive).alias("found"), F.col("label").isin(*positive).alias("true"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = x.groupBy("fold").agg(n(F.col("found") & F.col("true")).alias("tp"), n(F.col("found") & ~F.col("true")).alias("fp"), n(~F.col("found") & F.col("true")).alias("fn"))
    return out.withColumn("f1", F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(F.lit(0.0)))
