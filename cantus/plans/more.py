"""Queries of maps, labels, tests, audit cases and named discovery, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.scalar import unit
from ..operators import audit, discover, evaluate, prep, scorer, tokens
from ..operators import retrieval as r
from ..operators.graph import in_parts
from ..session import ANNOTATED_SQL, annotated_notes, notes_view, table
from . import evaluation, geometry, music, retrieval

SHIFTS, OFFSETS = (-1, 0, 2), (0, 16)
SCORERS = (scorer.LinearScorer(((0.5, -0.25, 0.0, 0.125), (0.25, 0.0, 0.03125, 0.0), (0.0, 0.125, -0.0625, 0.25), (-0.5, 0.0, 0.0, 0.0)), (0.0, -1.0, 2.0, 1.5)), scorer.LinearScorer(((0.0, 0.125, 0.0, 0.0), (0.0, 0.0, 0.0625, -0.125), (1.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.03125, 0.0)), (0.5, 0.0, -1.0, 0.25)))


def velocity_bins(spark: SparkSession, d: str) -> DataFrame:
    v = (F.col("onset") * 7 + F.col("pitch")) % 128
    return annotated_notes(spark, d).groupBy(scalar.velocity_bin(v).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def key_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Keys and chord qualities spelled from the notes' numbers, as numbers."""
    n = annotated_notes(spark, d)
    key = F.concat(F.substring(F.lit("CDEFGABcdefgabH"), (F.col("pitch") % 15 + 1).cast("int"), F.lit(1)), F.element_at(F.array(F.lit(""), F.lit("+"), F.lit("-")), (F.col("onset") % 3 + 1).cast("int")))
    quality = F.element_at(F.array(*map(F.lit, ("M", "m", "d7", "a6", "?"))), (F.col("onset") % 5 + 1).cast("int"))
    return n.groupBy(key.alias("key"), quality.alias("quality"), scalar.tonic_number(key).cast("long").alias("tonic"), scalar.quality_number(quality).cast("long").alias("number")).agg(F.count(F.lit(1)).alias("n"))


def note_boundaries(spark: SparkSession, d: str) -> DataFrame:
    label, flag = scalar.boundary(F.when(F.col("type") == "view", "").otherwise(F.col("type")))
    return annotated_notes(spark, d).groupBy(label.alias("label"), flag.cast("long").alias("flag")).agg(F.count(F.lit(1)).alias("n"))


def logged_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics written as a run's log, and read from it again."""
    m = evaluation.establishment(spark, d)
    log = m.select("piece_id", F.concat(F.lit("x\nMean_est P "), F.format_string("%.4f", "precision"), F.lit(", R "), F.format_string("%.4f", "recall"), F.lit(", F "), F.format_string("%.4f", "f1"), F.lit("\nMean_occ P 1")).alias("log"))
    return log.select("piece_id", scalar.logged_metrics(F.col("log")).alias("m")).select("piece_id", F.col("m.establishment.precision").alias("precision"), F.col("m.establishment.recall").alias("recall"), F.col("m.establishment.f1").alias("f1"), F.col("m.occurrence.f1").alias("occurrence"))


def price_test(spark: SparkSession, d: str) -> DataFrame:
    """Whether orders of one status cost more than the others: Welch's test, one-sided."""
    o = table(spark, d, "orders").select(F.col("o_totalprice").cast("double").alias("v"), "o_orderstatus", "o_orderkey")
    out = evaluate.welch_test(o, F.col("o_orderstatus") == "F", F.col("v"))
    return out.select(F.round("t", 5).alias("t"), F.round("p_greater", 5).alias("p_greater"))


def label_contrast(spark: SparkSession, d: str) -> DataFrame:
    """Mean cosine of embeddings with the same label and with different ones."""
    e = table(spark, d, "embeddings").where("embedding is not null and label is not null").select(F.lit(0).alias("group"), "label", unit(F.col("embedding")).alias("u"))
    out = evaluate.same_and_different(e)
    return out.select("same_pairs", "different_pairs", F.round("same_mean", 5).alias("same_mean"), F.round("different_mean", 5).alias("different_mean"))


def top_duplicates(spark: SparkSession, d: str) -> DataFrame:
    out = audit.top_duplicates(evaluation._motifs(spark, d), 10)
    return out.select(F.col("place").cast("long").alias("place"), "piece_id", "ma", "mb", F.round("jaccard", 6).alias("jaccard"), F.round("iou", 6).alias("iou"))


def top_sparse(spark: SparkSession, d: str) -> DataFrame:
    out = audit.top_sparse(evaluation._motifs(spark, d), 10, 4.0)
    return out.select(F.col("place").cast("long").alias("place"), "piece_id", "motif", F.round("ratio", 6).alias("ratio"))


def top_explosions(spark: SparkSession, d: str) -> DataFrame:
    """Pieces with most motifs: of onsets modulo 7 of the loudest half of pitches, so that pieces differ."""
    m = evaluation._motifs(spark, d).where("pitch >= 72").withColumn("motif", F.col("motif") * 7 + F.col("onset") % 7)
    return audit.top_explosions(m, 8).select(F.col("place").cast("long").alias("place"), "piece_id", "n_motifs")


def _cases(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Motifs in windows of 28 steps, and as cases of every piece its motifs 1 and 11 together, and motif 2 alone."""
    m = evaluation._motifs(spark, d)
    p = m.select("piece_id").distinct()
    pair = m.where("motif = 1").select("piece_id").distinct().join(m.where("motif = 11").select("piece_id").distinct(), "piece_id", "left_semi")
    both = pair.select((2 * F.col("piece_id")).alias("case"), "piece_id", F.lit(1).cast("long").alias("ma"), F.lit(11).cast("long").alias("mb"))
    alone = p.select((2 * F.col("piece_id") + 1).alias("case"), "piece_id", F.lit(2).cast("long").alias("ma"), F.lit(None).cast("long").alias("mb"))
    return m, both.unionByName(alone)


def audit_views(spark: SparkSession, d: str) -> DataFrame:
    return audit.views(*_cases(spark, d), pad=1.0, context=3.0)


def audit_case(spark: SparkSession, d: str) -> DataFrame:
    """The notes of both motifs of the third case."""
    m = evaluation._motifs(spark, d)
    case = audit.pick_case(audit.top_duplicates(m, 10), 2).select("piece_id", F.explode(F.array("ma", "mb")).alias("motif"))
    return m.join(case, ["piece_id", "motif"], "left_semi").select("piece_id", "motif", "occ", "onset", "pitch")


def span_filled_motifs(spark: SparkSession, d: str) -> DataFrame:
    spans = audit.occurrence_spans(evaluation._motifs(spark, d)).select("piece_id", "motif", "occ", "start", "end")
    return audit.span_filled(spans, notes_view(spark, d)).groupBy("piece_id", "motif", "occ").agg(F.count(F.lit(1)).alias("n"), F.sum("pitch").alias("pitches"))


def aligned_labels(spark: SparkSession, d: str) -> DataFrame:
    words = tokens.events(music._barred(spark, d)).join(annotated_notes(spark, d).select("piece_id", "onset", "pitch", F.when(F.col("type") == "view", "").otherwise(F.col("type")).alias("type")), ["piece_id", "onset", "pitch"])
    return tokens.aligned_labels(tokens.chunks(words, 8, 32), 32).select("piece_id", "chunk", F.col("pos").cast("long").alias("pos"), F.col("label").cast("long").alias("label"))


def pitch_variants(spark: SparkSession, d: str) -> DataFrame:
    notes = annotated_notes(spark, d).withColumn("type", F.when(F.col("type") == "view", "").otherwise(F.col("type")))
    return tokens.variants(notes, SHIFTS, OFFSETS).groupBy("piece_id", "semitones", "offset").agg(F.count(F.lit(1)).alias("n"), F.sum("pitch").alias("pitches"))


def qualified_pieces(spark: SparkSession, d: str) -> DataFrame:
    n = annotated_notes(spark, d)
    beats = n.select("piece_id", (3 + (F.col("piece_id") + 0 * F.col("pitch")) % 2).alias("place"), (F.col("pitch") % 4 == 0).cast("int").alias("major"), (F.col("pitch") % 3 == 0).cast("int").alias("minor"))
    return prep.qualified_beats(beats).select("piece_id", F.col("meter").cast("long").alias("meter"), F.round("share", 6).alias("share"), "qualified")


def retrieval_sweep_top(spark: SparkSession, d: str) -> DataFrame:

    def of(notes: DataFrame) -> DataFrame:
        _, segs, sims = r.compared(notes, retrieval.TOP)
        return r.sweep_top(sims, segs, (0.8, 0.9), (0.25, 0.5), (0, 1, 5))

    return in_parts(notes_view(spark, d), of).select("piece_id", "similarity", "iou", F.col("top_k").cast("long").alias("top_k"), "n_edges", "n_segments")


def scored_melody(spark: SparkSession, d: str) -> DataFrame:
    """Notes that two linear scorers together call melody, from tokens and back to notes."""
    words = music.bar_tokens(spark, d)
    return scorer.melody(words, list(SCORERS), length=32).select("piece_id", "w", "onset", "pitch", "duration")


def siatec_motifs(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences of the classes of at least a compression ratio."""
    out = discover.siatec(notes_view(spark, d), geometry.LEAST_CR)
    return out.select("piece_id", "motif", F.col("occurrence").cast("long").alias("occurrence"), "onset", "pitch")


def siatec_cs_motifs(spark: SparkSession, d: str) -> DataFrame:
    return discover.discover(notes_view(spark, d), "SIATEC_CS")


def default_motifs(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval with its default settings."""
    return discover.discover(notes_view(spark, d), "LR_DEFAULT")


QUERIES = {f.__name__: f for f in (velocity_bins, key_numbers, note_boundaries, logged_metrics, price_test, label_contrast, top_duplicates, top_sparse, top_explosions, audit_views, audit_case, span_filled_motifs, aligned_labels, pitch_variants, qualified_pieces, retrieval_sweep_top, scored_melody, siatec_motifs, siatec_cs_motifs, default_motifs)}


def _area(upto: str) -> str:
    return f"({upto} * list_sum(list_transform(range({scalar.GRID}), lambda k: pow(1 + pow(((k + 0.5) / {scalar.GRID} * {upto}) / (1 - (k + 0.5) / {scalar.GRID} * {upto}), 2) / f, -(f + 1) / 2) / pow(1 - (k + 0.5) / {scalar.GRID} * {upto}, 2))))"


def _score(s: scorer.LinearScorer, k: int) -> str:
    return " + ".join(f"{w} * {c}" for w, c in zip(s.weights[k], ("t_bar", "t_position", "t_pitch", "t_duration"))) + f" + {s.bias[k]}"


TYPES = ANNOTATED_SQL + ", ty AS (SELECT *, CASE WHEN type = 'view' THEN '' ELSE type END AS kind FROM anno)"
DUPLICATES = evaluation.OVERLAPS + """,
td AS (SELECT row_number() OVER (ORDER BY jaccard DESC, iou DESC, piece_id, ma, mb) AS place, * FROM bo)"""
ENCODED = music.WORDS + """,
tok AS (SELECT piece_id, w, CASE WHEN is_new THEN 0 ELSE 1 END AS t_bar, CAST(greatest(0, least(15, ceil((onset - s) / (e - s) * 16 - 0.5))) AS BIGINT) AS t_position, greatest(0, least(85, pitch - 22)) AS t_pitch, CAST(greatest(0, least(63, ceil((duration - 60) / 60 - 0.5))) AS BIGINT) AS t_duration FROM w)"""
ORACLE = {
    "velocity_bins": f"WITH {ANNOTATED_SQL}, v AS (SELECT (onset * 7 + pitch) % 128 AS v FROM anno) SELECT CASE WHEN v < 32 THEN 0 WHEN v < 48 THEN 1 WHEN v < 64 THEN 2 WHEN v < 80 THEN 3 WHEN v < 96 THEN 4 WHEN v < 128 THEN 5 ELSE 6 END::BIGINT AS bin, count(*) AS n FROM v GROUP BY 1",
    "key_numbers": f"""WITH {ANNOTATED_SQL}, k AS (SELECT substr('CDEFGABcdefgabH', pitch % 15 + 1, 1) AS l, ['', '+', '-'][onset % 3 + 1] AS sg, ['M', 'm', 'd7', 'a6', '?'][onset % 5 + 1] AS quality FROM anno),
t AS (SELECT l || sg AS key, quality, CASE upper(l) WHEN 'C' THEN 0 WHEN 'D' THEN 2 WHEN 'E' THEN 4 WHEN 'F' THEN 5 WHEN 'G' THEN 7 WHEN 'A' THEN 9 WHEN 'B' THEN 11 END AS st, CASE sg WHEN '+' THEN 1 WHEN '-' THEN -1 ELSE 0 END AS al, l = lower(l) AND (sg = '-' OR sg = '+' AND l IN ('e', 'b')) AS mi FROM k)
SELECT key, quality, ((st + al + 12) % 12 + CASE WHEN mi THEN 12 ELSE 0 END)::BIGINT AS tonic, CASE quality WHEN 'M' THEN 0 WHEN 'm' THEN 1 WHEN 'd7' THEN 7 WHEN 'a6' THEN 9 END::BIGINT AS number, count(*) AS n FROM t GROUP BY ALL""",
    "note_boundaries": f"WITH {TYPES} SELECT CASE WHEN kind = '' THEN 'z' ELSE kind END AS label, CASE WHEN kind = '' THEN 0 ELSE 1 END::BIGINT AS flag, count(*) AS n FROM ty GROUP BY 1, 2",
    "logged_metrics": f"WITH e AS ({evaluation.ORACLE['establishment']}) SELECT piece_id, printf('%.4f', precision)::DOUBLE AS precision, printf('%.4f', recall)::DOUBLE AS recall, printf('%.4f', f1)::DOUBLE AS f1, NULL::DOUBLE AS occurrence FROM e",
    "price_test": f"""WITH s AS (SELECT avg(v) FILTER (f) AS m1, avg(v) FILTER (NOT f) AS m0, var_samp(v) FILTER (f) AS v1, var_samp(v) FILTER (NOT f) AS v0, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n0 FROM (SELECT CAST(o_totalprice AS DOUBLE) AS v, o_orderstatus = 'F' AS f FROM orders)),
x AS (SELECT (m1 - m0) / sqrt(v1 / n1 + v0 / n0) AS t, pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)) AS f FROM s), h AS (SELECT t, {_area('(abs(t) / (1 + abs(t)))')} / {_area('1.0')} / 2 AS h FROM x)
SELECT round(t, 5) AS t, round(CASE WHEN t >= 0 THEN 0.5 - h ELSE 0.5 + h END, 5) AS p_greater FROM h""",
    "label_contrast": """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
p AS (SELECT a.label = b.label AS same, CASE WHEN a.n < 1e-9 OR b.n < 1e-9 THEN 0 ELSE list_dot_product(a.v, b.v) / (a.n * b.n) END AS c FROM e a JOIN e b ON a.vec_id < b.vec_id)
SELECT count(*) FILTER (same) AS same_pairs, count(*) FILTER (NOT same) AS different_pairs, round(avg(c) FILTER (same), 5) AS same_mean, round(avg(c) FILTER (NOT same), 5) AS different_mean FROM p""",
    "top_duplicates": f"WITH {DUPLICATES} SELECT place, piece_id, ma, mb, round(jaccard, 6) AS jaccard, round(iou, 6) AS iou FROM td WHERE place <= 10",
    "top_sparse": f"WITH {evaluation.SUMMARY} SELECT row_number() OVER (ORDER BY s1 / n DESC, piece_id, motif) AS place, piece_id, motif, round(s1 / n, 6) AS ratio FROM mm WHERE s1 / n >= 4.0 QUALIFY place <= 10",
    "top_explosions": f"WITH {evaluation.MOTIFS}, c AS (SELECT piece_id, count(DISTINCT motif * 7 + onset % 7) AS n_motifs FROM mo WHERE pitch >= 72 GROUP BY 1) SELECT row_number() OVER (ORDER BY n_motifs DESC, piece_id DESC) AS place, piece_id, n_motifs FROM c QUALIFY place <= 8",
    "audit_views": f"""WITH RECURSIVE {evaluation.OVERLAPS},
pr AS (SELECT a.piece_id, a.occ AS oa, b.occ AS ob, a.t0 AS a0, a.t1 AS a1, b.t0 AS b0, b.t1 AS b1, coalesce(o.jaccard, 0) AS j, CASE WHEN greatest(a.t1, b.t1) > least(a.t0, b.t0) THEN greatest(0, least(a.t1, b.t1) - greatest(a.t0, b.t0)) / (greatest(a.t1, b.t1) - least(a.t0, b.t0)) ELSE 0 END AS i
  FROM sp a JOIN sp b ON a.piece_id = b.piece_id AND a.motif = 1 AND b.motif = 11 LEFT JOIN o ON o.piece_id = a.piece_id AND o.ma = 1 AND o.mb = 11 AND o.oa = a.occ AND o.ob = b.occ),
fo AS (SELECT 2 * piece_id AS c, piece_id, least(a0, b0) - 1.0 AS lo, greatest(a1, b1) + 1.0 AS hi FROM pr QUALIFY row_number() OVER (PARTITION BY piece_id ORDER BY j DESC, i DESC, oa, ob) = 1
  UNION ALL (SELECT 2 * piece_id + 1, piece_id, t0 - 1.0, t1 + 1.0 FROM sp WHERE motif = 2 QUALIFY row_number() OVER (PARTITION BY piece_id ORDER BY n DESC, span, occ) = 1)),
s1 AS (SELECT fo.c, row_number() OVER (PARTITION BY fo.c ORDER BY sp.motif, sp.occ) AS k, count(*) OVER (PARTITION BY fo.c) AS n, t0, t1 FROM fo JOIN sp ON sp.piece_id = fo.piece_id AND (fo.c % 2 = 0 AND sp.motif IN (1, 11) OR fo.c % 2 = 1 AND sp.motif = 2)),
st AS (SELECT c, piece_id, 0 AS nr, lo, hi FROM fo
  UNION ALL SELECT st.c, st.piece_id, st.nr + 1, CASE WHEN t1 >= lo - 3.0 AND t0 <= hi + 3.0 THEN least(lo, t0 - 1.0) ELSE lo END, CASE WHEN t1 >= lo - 3.0 AND t0 <= hi + 3.0 THEN greatest(hi, t1 + 1.0) ELSE hi END FROM st JOIN s1 ON s1.c = st.c AND s1.k = st.nr % s1.n + 1 AND st.nr < 3 * s1.n)
SELECT c AS "case", piece_id, lo::DOUBLE AS start, hi::DOUBLE AS "end" FROM st QUALIFY row_number() OVER (PARTITION BY c ORDER BY nr DESC) = 1""",
    "audit_case": f"WITH {DUPLICATES} SELECT m.piece_id, m.motif, m.occ, m.onset, m.pitch FROM mo m JOIN td ON td.piece_id = m.piece_id AND m.motif IN (td.ma, td.mb) WHERE place = 3",
    "span_filled_motifs": f"WITH {evaluation.MOTIFS} SELECT s.piece_id, s.motif, s.occ, count(*) AS n, sum(n.pitch)::BIGINT AS pitches FROM sp s JOIN (SELECT DISTINCT piece_id, onset, pitch FROM anno) n ON n.piece_id = s.piece_id AND n.onset BETWEEN s.t0 AND s.t1 GROUP BY 1, 2, 3",
    "aligned_labels": f"""WITH {music.WORDS}, c AS (SELECT w.piece_id, CAST(floor((w.w + 8) / 32) AS BIGINT) AS chunk, (w.w + 8) % 32 AS pos, CASE WHEN a.type = 'view' THEN 3 ELSE 1 END AS label FROM w JOIN anno a USING (piece_id, onset, pitch)),
p AS (SELECT DISTINCT piece_id, chunk, unnest(range(32)) AS pos FROM c) SELECT p.piece_id, p.chunk, p.pos, coalesce(c.label, 0)::BIGINT AS label FROM p LEFT JOIN c USING (piece_id, chunk, pos)""",
    "pitch_variants": f"""WITH {TYPES}, v AS (SELECT unnest([{', '.join(map(str, SHIFTS))}])::INTEGER AS semitones), o AS (SELECT unnest([{', '.join(map(str, OFFSETS))}])::INTEGER AS "offset")
SELECT piece_id, semitones, "offset", count(*) AS n, sum(CASE WHEN kind = '' THEN greatest(24, least(107, pitch + semitones)) ELSE pitch END)::BIGINT AS pitches FROM ty, v, o GROUP BY 1, 2, 3""",
    "qualified_pieces": f"""WITH {ANNOTATED_SQL}, s AS (SELECT piece_id, (3 + piece_id % 2)::BIGINT AS meter, avg((pitch % 4 = 0)::INT) AS major, avg((pitch % 3 = 0)::INT) AS minor FROM anno GROUP BY 1, 2)
SELECT piece_id, meter, round(CASE WHEN meter = 4 THEN major ELSE minor END, 6) AS share, CASE WHEN meter = 4 THEN abs(0.25 - major) < 0.03 ELSE abs(0.33 - minor) < 0.03 END AS qualified FROM s""",
    "retrieval_sweep_top": f"""WITH {retrieval.RANKED},
g AS (SELECT piece_id, a, b, similarity, t.iou, top_k FROM nb, (SELECT unnest([0.8, 0.9])::DOUBLE AS similarity), (SELECT unnest([0.25, 0.5])::DOUBLE AS iou) t, (SELECT unnest([0, 1, 5])::BIGINT AS top_k) WHERE (sim >= similarity OR rank <= top_k) AND nb.iou < t.iou AND same),
nd AS (SELECT piece_id, similarity, iou, top_k, count(DISTINCT x) AS n_segments FROM (SELECT piece_id, similarity, iou, top_k, unnest([a, b]) AS x FROM g) GROUP BY 1, 2, 3, 4)
SELECT piece_id, similarity, iou, top_k, count(*) AS n_edges, any_value(n_segments) AS n_segments FROM g JOIN nd USING (piece_id, similarity, iou, top_k) GROUP BY 1, 2, 3, 4""",
    "scored_melody": f"""WITH {ENCODED}, sc AS ({' UNION ALL '.join(f"SELECT piece_id, w, {n} AS run, CAST(floor(w / 32) AS BIGINT) AS chunk, " + ', '.join(f'{_score(s, k)} AS s{k}' for k in range(4)) + ' FROM tok' for n, s in enumerate(SCORERS))}),
li AS (SELECT *, least(0, max(greatest(s1, s2) - greatest(s0, s3)) OVER (PARTITION BY piece_id, run, chunk)) AS lift FROM sc),
su AS (SELECT piece_id, w, round(sum(s0), 6) AS s0, round(sum(s1 - lift), 6) AS s1, round(sum(s2 - lift), 6) AS s2, round(sum(s3), 6) AS s3 FROM li GROUP BY 1, 2),
me AS (SELECT piece_id, w FROM su WHERE greatest(s1, s2) > s0 AND greatest(s1, s2) >= s3),
de AS (SELECT piece_id, w, (sum(1 - t_bar) OVER (PARTITION BY piece_id ORDER BY w) - 1) * 16 + t_position AS onset, t_pitch + 22 AS pitch, t_duration + 1 AS duration FROM tok)
SELECT piece_id, w, onset::BIGINT AS onset, pitch, duration FROM de JOIN me USING (piece_id, w)""",
    "siatec_motifs": f"""WITH {geometry.MEASURES}, tr AS (SELECT *, row_number() OVER (PARTITION BY piece_id, d_onset, d_pitch ORDER BY t_onset, t_pitch) - 1 AS k FROM trans)
SELECT m.piece_id, m.d_onset || ':' || m.d_pitch AS motif, tr.k AS occurrence, p.onset + tr.t_onset AS onset, p.pitch + tr.t_pitch AS pitch FROM m JOIN tr USING (piece_id, d_onset, d_pitch) JOIN tp p USING (piece_id, d_onset, d_pitch) WHERE m.cr >= {geometry.LEAST_CR}""",
}
