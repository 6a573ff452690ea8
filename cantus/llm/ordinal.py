"""Severity of toxicity by cumulative-link ordinal regression on sparse text features.

P(grade > k) = logistic(w . x - t_k): one weight vector shared by all thresholds t_0 < t_1 < ...; the expected severity
is the sum of these probabilities. The model is fitted on a bounded sample of labelled rows, everything else is a scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernels as K
from ._store import lean

#: Labelled rows that the model is fitted on at most: those whose ids hash lowest.
SAMPLE = 8000
#: Different features of one labelled text that the fit takes at most.
MOST = 4096
BITS = 20
#: Bytes of a word's beginning that are features besides the whole word.
PREFIXES = (5, 6, 7, 8)
#: Standard errors by which a feature's frequency must differ between grade 0 and the others.
LEAST_Z = 4.0
#: Separators of the words that are features: ASCII other than letters and digits.
_SEPARATORS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return 1 / (1 + np.exp(-(score[:, None] - self.thresholds[None, :])))


def features(part: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hashed feature) of words and their beginnings, with repetitions."""
    start, end, at = K.words(part, off, _SEPARATORS)
    p = K.prefix(K.LOWER[part], "byte")
    doc = np.repeat(np.arange(len(off) - 1), np.diff(at))
    docs, out = [doc], [K.ranges(p, start, end, "byte")]
    for n in PREFIXES:
        long = end - start > n
        docs.append(doc[long])
        out.append(K.ranges(p, start[long], start[long] + n, "byte") ^ np.uint64(0x1234567))
    return np.concatenate(docs), (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64)


def likelihood(t0: float, gaps: np.ndarray, w: np.ndarray, row: np.ndarray, col: np.ndarray, y: np.ndarray, weight: np.ndarray, shrink: float) -> tuple[float, list[np.ndarray]]:
    """The penalised log likelihood of grades y and its gradient by t0, gaps and w. Features are pairs (row, col); the
    thresholds are t0 and t0 plus running sums of exp(gaps), so that they stay in order."""
    n, grown = len(y), len(gaps) + 1
    t = t0 + np.concatenate([[0], np.cumsum(np.exp(gaps))])
    s = np.bincount(row, w[col], n) if len(col) else np.zeros(n)
    up = 1 / (1 + np.exp(-(s[:, None] - t[None, :])))
    full = np.concatenate([np.ones((n, 1)), up, np.zeros((n, 1))], 1)
    i = np.arange(n)
    mass = np.maximum(full[i, y] - full[i, y + 1], 1e-12)
    slope = up * (1 - up)
    d = np.zeros((n, grown))  # derivative of the log likelihood by each threshold's margin
    at = y > 0
    d[i[at], y[at] - 1] += slope[i[at], y[at] - 1] / mass[at]
    at = y < grown
    d[i[at], y[at]] -= slope[i[at], y[at]] / mass[at]
    d *= weight[:, None]
    by_row, by_t = d.sum(1), -d.sum(0)
    share = shrink / max(len(w), 1)
    grad_w = (np.bincount(col, by_row[row], len(w)) if len(col) else np.zeros(len(w))) - share * w
    return float((weight * np.log(mass)).sum() - share * (w @ w) / 2), [np.array([by_t.sum()]), np.array([by_t[k + 1 :].sum() * np.exp(g) for k, g in enumerate(gaps)]), grad_w]


def telling(row: np.ndarray, col: np.ndarray, toxic: np.ndarray, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(used, marker) of each hashed feature, by its frequency in toxic and other rows (those in `of`): used if the two differ by LEAST_Z
    standard errors, a marker if it is toxic rows that have it more often."""
    of = np.ones(len(toxic), bool) if of is None else of
    n1, n0 = max((toxic & of).sum(), 1), max((~toxic & of).sum(), 1)
    d1, d0 = (np.bincount(col[(k & of)[row]], minlength=1 << BITS) for k in (toxic, ~toxic))
    p = (d1 + d0) / (n1 + n0)
    z = (d1 / n1 - d0 / n0) / np.sqrt(np.maximum(p * (1 - p) * (1 / n1 + 1 / n0), 1e-12))
    use = (np.abs(z) >= LEAST_Z) & (d1 + d0 >= 3)
    return use, use & (z > 0)


def descend(row: np.ndarray, col: np.ndarray, y: np.ndarray, n: int, rounds: int, shrink: float) -> tuple[np.ndarray, np.ndarray]:
    """(thresholds, weights of n features) after so many gradient steps of AdaGrad on the penalised likelihood of grades y; (row, col) are the
    features that rows have. Grade 0 and the others weigh alike in sum."""
    toxic = y > 0
    t0, gaps, w = 0.0, np.full(max(int(y.max()) - 1, 0), 2.0), np.zeros(n)
    weight = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
    sums = [np.full_like(v, 1e-8, dtype=float) for v in (np.zeros(1), gaps, w)]
    for _ in range(rounds):
        _, grads = likelihood(t0, gaps, w, row, col, y, weight, shrink)
        for total, g in zip(sums, grads):
            total += g * g
        t0 += 0.3 * (grads[0] / np.sqrt(sums[0]))[0]
        gaps = gaps + 0.3 * grads[1] / np.sqrt(sums[1])
        w = w + 0.3 * grads[2] / np.sqrt(sums[2])
    return t0 + np.concatenate([[0], np.cumsum(np.exp(gaps))]), w


def fit(docs: DataFrame, grades: DataFrame, sample: int = SAMPLE, rounds: int = 400, shrink: float = 0.1, most: int = MOST) -> Model:
    """docs (doc_id, text), grades (doc_id, grade from 0). Grades that repeat an id count as their maximum; null ones are not labels.

    The fit takes at most `sample` labelled ids, one text of each (of several the one with the least hash), and of a text at most `most` different
    features (those of the least hash), so what reaches the driver is bounded in rows and in bytes.

    Labels that only tell 0 from 1 are refined: rows of grade 1 with more distinct markers (features that are much more
    frequent in it) than its median get grade 2, so that severity is graded by how much of a text is toxic. Markers of one
    half of the rows grade the other half, so that no row is graded by features that it chose itself.
    """
    lean(docs.sparkSession)
    graded = grades.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.buffers(batch.column("text"))
            out = []
            for i, j in K.chunks(offsets):
                doc, f = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                key = np.unique((doc << BITS) | f)
                cut = np.searchsorted(key, np.arange(j - i + 1) << BITS)
                own = [(key[a:b] & ((1 << BITS) - 1)).astype(np.int32) for a, b in zip(cut, cut[1:])]
                out += [(f if len(f) <= most else f[np.sort(np.argsort(K.mix(f.astype(np.uint64)), kind="stable")[:most])]).tobytes() for f in own]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array(out, pa.binary())], names=["doc_id", "grade", "features"])

    text = F.coalesce("text", F.lit(""))
    one = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(F.min_by(text, F.struct(F.xxhash64(text), F.length(text))).alias("text"))
    rows = sorted(one.select("doc_id", "grade", "text").mapInArrow(sparse, "doc_id long, grade int, features binary").collect(), key=lambda r: (r.doc_id, r.features))
    y = np.array([r.grade for r in rows], np.int64)
    grown = int(y.max()) if len(y) else 0
    if len(np.unique(y)) < 2:  # nothing to tell apart
        return Model(np.zeros(1 << BITS, np.float32), np.full(max(grown, 1), -20.0 if len(y) and y.min() else 20.0))
    x = [np.frombuffer(r.features, np.int32) for r in rows]
    row, col = np.repeat(np.arange(len(x)), [len(v) for v in x]), np.concatenate(x)
    toxic = y > 0
    use, _ = telling(row, col, toxic)
    if grown == 1:
        half = np.arange(len(y)) % 2 == 0
        markers = np.zeros(len(y))
        for own in (half, ~half):
            _, marker = telling(row, col, toxic, ~own)
            markers += np.where(own, np.bincount(row, marker[col], len(y)), 0)
        y = np.where(toxic, 1 + (markers > np.median(markers[toxic])), 0)
    ids = np.flatnonzero(use)
    keep = use[col]
    row, col = row[keep], np.searchsorted(ids, col[keep])

    thresholds, w = descend(row, col, y, len(ids), rounds, shrink)
    weights = np.zeros(1 << BITS, np.float32)
    weights[ids] = w
    return Model(weights, thresholds)


def severity(docs: DataFrame, model: Model, reject: float = 0.55, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs and severity (expected grade), p_toxic (of any grade above 0) and toxic (p_toxic of at least `reject`).

    Words are split at ASCII other than letters and digits, A-Z lower-cased. Null and empty texts have no features. Rows
    with a null id and rows that repeat an id are scored like others. Where docs has columns of these names, the new
    ones take their place; an empty table gives an empty result.
    """
    lean(docs.sparkSession)
    docs = docs.drop("severity", "p_toxic", "toxic")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = shared.value
        for batch in batches:
            data, offsets = K.buffers(batch.column(names.index(text_col)))
            total = np.zeros(batch.num_rows)
            for i, j in K.chunks(offsets):
                doc, f = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                some = weights[f] != 0
                key = np.unique((doc[some] << BITS) | f[some])
                total[i:j] = np.bincount(key >> BITS, weights[key & ((1 << BITS) - 1)], j - i)
            up = Model(weights, thresholds).above(total)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(up.sum(1)), pa.array(up[:, 0]), pa.array(up[:, 0] >= reject)], names=[*names, "severity", "p_toxic", "toxic"])

    kinds = ", ".join(f"`{c}` {k}" for c, k in docs.dtypes)
    return docs.mapInArrow(score, f"{kinds}, severity double, p_toxic double, toxic boolean")


def grades_from_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.col("toxic").alias("grade"))
