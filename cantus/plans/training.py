"""Queries of training preparation and losses, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval, scorer, tokens
from ..operators import training as t
from ..session import annotated_notes, notes_view, table
from . import more, music
from .retrieval import STEPS

BATCH, TEMPERATURE, LENGTH, ROUNDS, RATE, DECAY = 32, 0.1, 64, 4, 2.0, 0.01
WEIGHTS, POSITIVE = (1.0, 2.0, 1.0, 1.0), (1, 2)
TEMPO, JITTER, DROP, VARIANTS = (0.8, 1.25), 0.05, 0.3, 2


def _batched(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    return t.contrastive_batches(e, BATCH)


def contrastive_batches(spark: SparkSession, d: str) -> DataFrame:
    return _batched(spark, d).select("id", F.col("batch").cast("long").alias("batch"), F.col("place").cast("long").alias("place"))


def contrastive_loss(spark: SparkSession, d: str) -> DataFrame:
    out = t.contrastive_loss(_batched(spark, d).where("batch is not null"), TEMPERATURE, block=16, vector_col="embedding")
    return out.select(F.col("batch").cast("long").alias("batch"), "n", "n_valid", F.round("loss", 4).alias("loss"))


def augmented_steps(spark: SparkSession, d: str) -> DataFrame:
    cfg = retrieval.Config()
    steps = retrieval.steps(retrieval.membership(notes_view(spark, d), cfg)).select("piece_id", "seg", "i", "d_pitch", "d_time")
    out = t.augmented(steps, VARIANTS, TEMPO, JITTER, DROP)
    return out.select(F.col("variant").cast("long").alias("variant"), "piece_id", F.col("seg").cast("long").alias("seg"), F.col("i").cast("long").alias("i"), F.round("d_time", 5).alias("d_time"))


def masked_tokens(spark: SparkSession, d: str) -> DataFrame:
    words = music.bar_tokens(spark, d)
    out = t.masked(t.places(tokens.chunks(words, 8, LENGTH), LENGTH), length=LENGTH)
    return out.select("piece_id", F.col("chunk").cast("long").alias("chunk"), "pos", "plan", *(F.col(c).cast("long").alias(c) for c in ("m_bar", "m_position", "m_pitch", "m_duration")))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Tokens with a class by the note's type (click 1, view 2, others 3) and the piece's fold."""
    own = annotated_notes(spark, d).select("piece_id", "onset", "pitch", F.when(F.col("type") == "click", 1).when(F.col("type") == "view", 2).otherwise(3).alias("label"))
    words = tokens.encode(tokens.events(music._barred(spark, d)))
    return tokens.folds(words.join(own, ["piece_id", "onset", "pitch"]), F.col("piece_id"))


def token_loss(spark: SparkSession, d: str) -> DataFrame:
    """The loss of the first linear scorer on every fold, without the words of class 3 that don't begin a bar."""
    words = _labelled(spark, d)
    scores = scorer.scored(words, more.SCORERS[0]).join(words.select("piece_id", F.col("w").cast("long").alias("w"), "label", "fold", "t_bar"), ["piece_id", "w"])
    out = t.token_loss(scores, ["s0", "s1", "s2", "s3"], F.col("label"), WEIGHTS, (F.col("label") < 3) | (F.col("t_bar") == 0), ["fold"])
    return out.select(F.col("fold").cast("long").alias("fold"), "n", F.round("loss", 5).alias("loss"))


def fitted_folds(spark: SparkSession, d: str) -> DataFrame:
    """F1 on each fold of the scorer that is fitted on three others and chosen by a fourth."""
    words = _labelled(spark, d).select("fold", "label", *t.FIELDS)
    fits = t.fit(words, rounds=ROUNDS, patience=ROUNDS, rate=RATE, decay=DECAY, weights=WEIGHTS, positive=POSITIVE)
    out = t.fold_f1(words, fits, POSITIVE)
    return out.select(F.col("fold").cast("long").alias("fold"), "tp", "fp", "fn", F.round("f1", 6).alias("f1"))


QUERIES = {f.__name__: f for f in (contrastive_batches, contrastive_loss, augmented_steps, masked_tokens, token_loss, fitted_folds)}


def _draw(digest: str, k: int = 0) -> str:
    return f"CAST('0x' || substr({digest}, {8 * k + 1}, 8) AS BIGINT)"


def _uniform(digest: str, k: int = 0) -> str:
    return f"(({_draw(digest, k)} + 0.5) / 4294967296.0)"


BATCHES = f"""rw AS (SELECT vec_id AS id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY sha256('1:row:' || vec_id), vec_id) - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings WHERE label IS NOT NULL),
pr AS (SELECT id, label, embedding, sha256('1:pair:' || label || ':0:' || least(r // 2, n // 2 - 1)) AS h FROM rw WHERE n > 1),
dl AS (SELECT h, row_number() OVER (ORDER BY h) - 1 AS place FROM (SELECT DISTINCT h FROM pr)),
ba AS (SELECT id, label, embedding, place // {BATCH // 2} AS batch, row_number() OVER (PARTITION BY place // {BATCH // 2} ORDER BY place, id) - 1 AS place FROM pr JOIN dl USING (h))"""
LABELLED = more.ENCODED + """,
lb AS (SELECT tok.*, CASE WHEN a.type = 'click' THEN 1 WHEN a.type = 'view' THEN 2 ELSE 3 END AS label, CASE WHEN w.piece_id % 32 < 7 THEN 0 WHEN w.piece_id % 32 < 14 THEN 1 WHEN w.piece_id % 32 < 20 THEN 2 WHEN w.piece_id % 32 < 26 THEN 3 ELSE 4 END AS fold
  FROM tok JOIN w ON w.piece_id = tok.piece_id AND w.w = tok.w JOIN anno a ON a.piece_id = w.piece_id AND a.onset = w.onset AND a.pitch = w.pitch)"""


def _fit() -> str:
    """The rounds written out one after the other: w<r> holds each fold's weights before round r."""
    n, m = 4, 5
    x = [*(f"{f} / {s}.0" for f, s in zip(t.FIELDS, t.SIZES)), "1.0"]
    out = [LABELLED, "x AS MATERIALIZED (SELECT fold, label, " + ", ".join(f"{e} AS x{j}" for j, e in enumerate(x)) + ", CASE label WHEN 1 THEN 2.0 ELSE 1.0 END AS c FROM lb)",
           "w0 AS (SELECT unnest(range(5)) AS k, " + ", ".join(f"0.0::DOUBLE AS w{c}{j}" for c in range(n) for j in range(m)) + ")"]
    positive = "s.best IN (1, 2)"
    for r in range(ROUNDS):
        out.append(f"s{r} AS MATERIALIZED (SELECT k, x.*, " + ", ".join(f"{' + '.join(f'w{c}{j} * x{j}' for j in range(m))} AS s{c}" for c in range(n)) + f" FROM x, w{r})")
        out.append(f"p{r} AS MATERIALIZED (SELECT *, greatest(s0, s1, s2, s3) AS top, list_position([s0, s1, s2, s3], greatest(s0, s1, s2, s3)) - 1 AS best FROM s{r})")
        out.append(f"f{r} AS (SELECT k, count(*) FILTER (fold = (k + 1) % 5 AND {positive} AND label IN (1, 2)) AS b, count(*) FILTER (fold = (k + 1) % 5 AND {positive} <> (label IN (1, 2))) AS e FROM p{r} s GROUP BY k)")
        e = "exp(s0 - top) + exp(s1 - top) + exp(s2 - top) + exp(s3 - top)"
        out.append(f"g{r} AS (SELECT k, sum(c) AS cost, " + ", ".join(f"sum(c * (exp(s{c} - top) / ({e}) - CASE WHEN label = {c} THEN 1 ELSE 0 END) * x{j}) AS g{c}{j}" for c in range(n) for j in range(m)) + f" FROM p{r} WHERE fold <> k AND fold <> (k + 1) % 5 GROUP BY k)")
        out.append(f"w{r + 1} AS MATERIALIZED (SELECT k, " + ", ".join(f"w{c}{j} - {RATE} * (g{c}{j} / cost + {DECAY} * w{c}{j}) AS w{c}{j}" for c in range(n) for j in range(m)) + f" FROM w{r} JOIN g{r} USING (k))")
    choose = " UNION ALL ".join(f"SELECT k, {r} AS r, CASE WHEN b > 0 THEN 2 * b / (2 * b + e) ELSE 0 END AS f1 FROM f{r}" for r in range(ROUNDS))
    out.append(f"ch AS (SELECT k, r FROM ({choose}) QUALIFY row_number() OVER (PARTITION BY k ORDER BY f1 DESC, r) = 1)")
    own = " UNION ALL ".join(f"SELECT k AS fold, label, best FROM p{r} JOIN ch USING (k) WHERE ch.r = {r} AND fold = k" for r in range(ROUNDS))
    out.append(f"te AS (SELECT fold, count(*) FILTER (best IN (1, 2) AND label IN (1, 2)) AS tp, count(*) FILTER (best IN (1, 2) AND label NOT IN (1, 2)) AS fp, count(*) FILTER (best NOT IN (1, 2) AND label IN (1, 2)) AS fn FROM ({own}) GROUP BY fold)")
    return "WITH " + ",\n".join(out) + " SELECT fold, tp, fp, fn, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM te"


def _masked() -> str:
    n = round(LENGTH * 0.15)
    n_mask, n_random = round(n * 0.8), round(n * 0.1)
    x, shift = f"xor(pos, {_draw('key')} % {LENGTH})", (LENGTH.bit_length() - 1) // 2
    steps = []
    for k in (1, 3, 5):
        steps.append(f"({x} * (2 * ({_draw('key', k)} % {LENGTH // 2}) + 1) + {_draw('key', k + 1)}) % {LENGTH} AS y{k}")
        x = f"xor(y{k}, y{k} >> {shift})"
    ctes, before = [], "pl"
    for k, s in zip((1, 3, 5), steps):
        ctes.append(f"k{k} AS (SELECT *, {s} FROM {before})")
        before = f"k{k}"
    fields = ", ".join(f"CASE plan WHEN 'mask' THEN {size - 1} WHEN 'random' THEN {_draw('word', j)} % {size} ELSE {f} END::BIGINT AS {f.replace('t_', 'm_')}" for j, (f, size) in enumerate(zip(t.FIELDS, t.SIZES)))
    words = ", ".join(f"coalesce({f}, {s - 2}) AS {f}" for f, s in zip(t.FIELDS, t.SIZES))
    return f"""WITH {more.ENCODED}, ck AS (SELECT *, CAST(floor((w + 8) / {LENGTH}) AS BIGINT) AS chunk, (w + 8) % {LENGTH} AS pos FROM tok),
ev AS (SELECT DISTINCT piece_id, chunk, unnest(range({LENGTH})) AS pos FROM ck), pl AS (SELECT ev.*, {words}, sha256('1:chunk:' || piece_id || ':' || chunk) AS key FROM ev LEFT JOIN ck USING (piece_id, chunk, pos)),
{', '.join(ctes)}, pn AS (SELECT *, CASE WHEN y5 < {n_mask} THEN 'mask' WHEN y5 < {n_mask + n_random} THEN 'random' WHEN y5 < {n} THEN 'keep' END AS plan, sha256('1:word:' || piece_id || ':' || chunk || ':' || pos) AS word FROM k5)
SELECT piece_id, chunk, pos, plan, {fields} FROM pn"""


ORACLE = {
    "contrastive_batches": f"WITH {BATCHES} SELECT e.vec_id AS id, ba.batch, ba.place FROM embeddings e LEFT JOIN ba ON ba.id = e.vec_id",
    "contrastive_loss": f"""WITH {BATCHES}, un AS (SELECT id, label, batch, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM ba WHERE embedding IS NOT NULL),
s AS (SELECT a.batch, a.id, a.label = b.label AS same, CASE WHEN a.n < 1e-9 OR b.n < 1e-9 THEN 0 ELSE list_dot_product(a.v, b.v) / (a.n * b.n) END / {TEMPERATURE} AS s FROM un a JOIN un b ON a.batch = b.batch AND a.id <> b.id),
r AS (SELECT batch, id, ln(sum(exp(s)) + 1e-9) - avg(s) FILTER (same) AS loss FROM s GROUP BY 1, 2) SELECT batch, count(*) AS n, count(loss) AS n_valid, round(avg(loss), 4) AS loss FROM r GROUP BY 1""",
    "augmented_steps": f"""WITH {STEPS}, va AS (SELECT unnest(range({VARIANTS})) AS variant), hs AS (SELECT variant, piece_id, seg, i, d_time, sha256('1:tempo:' || variant || ':' || piece_id || ':' || seg) AS h, sha256('1:step:' || variant || ':' || piece_id || ':' || seg || ':' || i) AS g FROM st, va),
m2 AS (SELECT *, {_uniform('g', 2)} AS u FROM hs) SELECT variant, piece_id, seg, i, round(d_time + ln(greatest({TEMPO[0]} + {TEMPO[1] - TEMPO[0]} * {_uniform('h')}, 1e-4)) + {JITTER} * sqrt(-2 * ln({_uniform('g')})) * cos(2 * pi() * {_uniform('g', 1)}), 5) AS d_time
FROM m2 QUALIFY u > {DROP} OR row_number() OVER (PARTITION BY variant, piece_id, seg ORDER BY u DESC, i) = 1""",
    "masked_tokens": _masked(),
    "token_loss": f"""WITH {LABELLED}, sc AS (SELECT fold, label, t_bar, {', '.join(f'{more._score(more.SCORERS[0], k)} AS s{k}' for k in range(4))} FROM lb),
lo AS (SELECT fold, CASE label WHEN 1 THEN 2.0 ELSE 1.0 END * (greatest(s0, s1, s2, s3) + ln(exp(s0 - greatest(s0, s1, s2, s3)) + exp(s1 - greatest(s0, s1, s2, s3)) + exp(s2 - greatest(s0, s1, s2, s3)) + exp(s3 - greatest(s0, s1, s2, s3))) - [s0, s1, s2, s3][label + 1]) AS l FROM sc WHERE label < 3 OR t_bar = 0)
SELECT fold::BIGINT AS fold, count(*) AS n, round(avg(l), 5) AS loss FROM lo GROUP BY 1""",
    "fitted_folds": _fit(),
}
