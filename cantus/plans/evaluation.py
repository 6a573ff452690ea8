"""Queries of evaluation and audit, and their SQL.

Reference patterns are the event types of a piece, estimated ones its pitches modulo 5; occurrences are windows of 28 steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import dot, time_iou
from ..operators import audit as au
from ..operators import evaluate as ev
from ..session import ANNOTATED_SQL, annotated_notes, notes_view, table


def _sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    notes = annotated_notes(spark, d).withColumn("occ", F.floor(F.col("onset") / 28))
    ref = notes.select("piece_id", F.col("type").alias("pattern"), "occ", "onset", "pitch")
    est = notes.select("piece_id", (F.col("pitch") % 5).alias("pattern"), "occ", "onset", "pitch")
    return ref, est


def _motifs(spark: SparkSession, d: str) -> DataFrame:
    """Two overlapping families of motifs: pitches modulo 5, and pitches modulo 3 (from 10 on)."""
    notes = notes_view(spark, d).withColumn("occ", F.floor(F.col("onset") / 28))
    a = notes.select("piece_id", (F.col("pitch") % 5).alias("motif"), "occ", "onset", "pitch")
    return a.unionByName(notes.select("piece_id", (10 + F.col("pitch") % 3).alias("motif"), "occ", "onset", "pitch"))


def _two_windows(spark: SparkSession, d: str) -> DataFrame:
    """Motifs with windows of 28 steps and, numbered from 100 on, of 20 steps as their occurrences."""
    m = _motifs(spark, d)
    return m.withColumn("occ", F.floor(F.col("onset") / 28)).unionByName(m.withColumn("occ", 100 + F.floor(F.col("onset") / 20)))


def _rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*(F.round(c, n).alias(c) if k == "double" else F.col(c).cast("long").alias(c) if k == "int" else F.col(c) for c, k in df.dtypes))


def score_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.score_matrix(*_sets(spark, d)))


def establishment(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.establishment(ev.score_matrix(*_sets(spark, d))))


def occurrence_metric(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.occurrence(ev.score_matrix(*_sets(spark, d)), 0.5))


def three_layer(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.three_layer(ev.score_matrix(*_sets(spark, d))))


def macro_means(spark: SparkSession, d: str) -> DataFrame:
    m = ev.three_layer(ev.score_matrix(*_sets(spark, d)))
    return _rounded(m.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.count(F.lit(1)).alias("n_pieces")))


def first_five_establishment(spark: SparkSession, d: str) -> DataFrame:
    ref, _ = _sets(spark, d)
    est = notes_view(spark, d).withColumn("occ", F.floor(F.col("onset") / 28)).select("piece_id", (F.col("pitch") % 9).alias("pattern"), "occ", "onset", "pitch")
    return _rounded(ev.establishment(ev.score_matrix(ref, ev.first_patterns(est, 5))))


def translational_metric(spark: SparkSession, d: str) -> DataFrame:
    ref, est = _sets(spark, d)
    return _rounded(ev.translational(ref, est))


def best_piece(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(au.best_piece(ev.three_layer(ev.score_matrix(*_sets(spark, d))).withColumn("f1", F.round("f1", 9))))


def piece_audit(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(au.piece_summary(_motifs(spark, d), near=0.3, subset=0.5))


def audit_totals(spark: SparkSession, d: str) -> DataFrame:
    s = au.piece_summary(_motifs(spark, d), near=0.3, subset=0.5)
    means = [F.avg(c).alias(c) for c in ("n_motifs", "n_occurrences", "mean_jaccard", "mean_iou")]
    return _rounded(s.agg(F.count(F.lit(1)).alias("n_pieces"), *means, *(F.sum(c).alias(c) for c in ("near_duplicates", "subset_pairs", "n_sparse"))))


def best_motif_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(au.best_overlap(_motifs(spark, d)))


def within_motif_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Overlap in notes of the six largest occurrences of each motif; within_motif_audit has the report's limit, and time."""
    return _rounded(au.within_motif(_two_windows(spark, d), 6).drop("mean_iou", "max_iou"))


def within_motif_audit(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(au.within_motif(_two_windows(spark, d)))


def note_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(au.coverage(_motifs(spark, d).where("motif in (1, 2, 11)"), notes_view(spark, d)))


def span_bins(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(au.span_bins(_motifs(spark, d), (4, 8, 16, 24)))


def representative_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(au.representative(_motifs(spark, d)))


def price_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(au.percentiles(table(spark, d, "part").withColumn("v", F.col("p_retailprice").cast("double")), "v", "p_size"), 4)


def price_histogram(spark: SparkSession, d: str) -> DataFrame:
    return au.histogram(table(spark, d, "orders").withColumn("v", F.col("o_totalprice").cast("double")), "v", 0.0, 500000.0, 20)


def label_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Dot products of the embeddings within each label, from sums alone: the mean over pairs is (|sum|^2 - sum of |x|^2) / (n (n - 1))."""
    e = table(spark, d, "embeddings").where("embedding is not null")
    own = e.groupBy("label").agg(F.sum(dot(F.col("embedding"), F.col("embedding"))).alias("own"), F.count(F.lit(1)).alias("n"))
    total = e.select("label", F.posexplode("embedding").alias("k", "x")).groupBy("label", "k").agg(F.sum(F.col("x").cast("double")).alias("s")).groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("s2"))
    out = own.join(total, "label").where("n > 1").select("label", "n", ((F.col("s2") - F.col("own")) / (F.col("n") * (F.col("n") - 1))).alias("mean_similarity"))
    return out.select(F.col("label").cast("long").alias("label"), "n", F.round("mean_similarity", 5).alias("mean_similarity"))


def span_iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Mean time overlap of neighbouring occurrences of a motif that follow each other."""
    from pyspark.sql import Window

    s = au.occurrence_spans(_motifs(spark, d))
    w = Window.partitionBy("piece_id", "motif").orderBy("occ")
    out = s.select("piece_id", "motif", time_iou(F.col("start"), F.col("end") + 14, F.lead("start").over(w), F.lead("end").over(w) + 14).alias("iou"), F.lead("occ").over(w).alias("nxt")).where("nxt is not null")
    return _rounded(out.groupBy("piece_id").agg(F.avg("iou").alias("mean_iou")))


def toxic_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Low quality as a guess of toxicity."""
    return _rounded(ev.confusion(table(spark, d, "labels").where("quality is not null and toxic is not null"), F.col("toxic") == 1, F.col("quality") == 0))


def class_confusion(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").groupBy(F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic")).agg(F.count(F.lit(1)).alias("n"))


def fold_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy in five folds of documents, its mean and population deviation."""
    rows = table(spark, d, "labels").withColumn("fold", F.col("doc_id") % 5)
    acc = rows.groupBy("fold").agg(F.avg(F.when((F.col("toxic") == 1) == (F.col("quality") == 0), 1.0).otherwise(0.0)).alias("a"))
    return _rounded(acc.agg(F.avg("a").alias("mean"), F.stddev_pop("a").alias("deviation")))


QUERIES = {f.__name__: f for f in (score_matrix, establishment, occurrence_metric, three_layer, macro_means, first_five_establishment, translational_metric, best_piece, piece_audit, audit_totals, best_motif_overlap, within_motif_overlap, within_motif_audit, note_coverage, span_bins, representative_occurrences, price_percentiles, price_histogram, label_similarity, span_iou_pairs, toxic_confusion, class_confusion, fold_statistics)}

SETS = ANNOTATED_SQL + """,
ref AS (SELECT piece_id, type AS pattern, CAST(floor(onset / 28) AS BIGINT) AS occ, onset, pitch FROM anno),
est AS (SELECT piece_id, pitch % 5 AS pattern, CAST(floor(onset / 28) AS BIGINT) AS occ, onset, pitch FROM anno)"""
MATRIX = """,
a AS (SELECT piece_id, pattern AS rp, occ AS ro, count(*) AS nr FROM ref GROUP BY 1, 2, 3),
b AS (SELECT piece_id, pattern AS ep, occ AS eo, count(*) AS ne FROM est GROUP BY 1, 2, 3),
k AS (SELECT r.piece_id, r.pattern AS rp, r.occ AS ro, e.pattern AS ep, e.occ AS eo, count(*) AS shared FROM ref r JOIN est e USING (piece_id, onset, pitch) GROUP BY 1, 2, 3, 4, 5),
m AS (SELECT a.piece_id, a.rp, a.ro, b.ep, b.eo, coalesce(k.shared, 0) AS shared, nr, ne, coalesce(k.shared, 0) / greatest(nr, ne) AS score FROM a JOIN b USING (piece_id) LEFT JOIN k USING (piece_id, rp, ro, ep, eo))"""
EST = """,
s AS (SELECT piece_id, rp, ep, max(score) AS s FROM m GROUP BY 1, 2, 3),
p AS (SELECT piece_id, avg(x) AS precision FROM (SELECT piece_id, ep, max(s) AS x FROM s GROUP BY 1, 2) GROUP BY 1),
r AS (SELECT piece_id, avg(x) AS recall FROM (SELECT piece_id, rp, max(s) AS x FROM s GROUP BY 1, 2) GROUP BY 1)"""
PRF = "SELECT piece_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1"
LAYERS = """,
l AS (SELECT *, CASE WHEN shared > 0 THEN 2.0 * shared / (nr + ne) ELSE 0 END AS l1 FROM m),
pp AS (SELECT piece_id, rp, ep, avg(x) AS p FROM (SELECT piece_id, rp, ep, eo, max(l1) AS x FROM l GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
rr AS (SELECT piece_id, rp, ep, avg(x) AS r FROM (SELECT piece_id, rp, ep, ro, max(l1) AS x FROM l GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
s AS (SELECT piece_id, rp, ep, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS s FROM pp JOIN rr USING (piece_id, rp, ep)),
p AS (SELECT piece_id, avg(x) AS precision FROM (SELECT piece_id, ep, max(s) AS x FROM s GROUP BY 1, 2) GROUP BY 1),
r AS (SELECT piece_id, avg(x) AS recall FROM (SELECT piece_id, rp, max(s) AS x FROM s GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT piece_id, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM p JOIN r USING (piece_id))"""
MOTIFS = ANNOTATED_SQL + """,
mo AS (SELECT piece_id, pitch % 5 AS motif, CAST(floor(onset / 28) AS BIGINT) AS occ, onset, pitch FROM anno UNION ALL SELECT piece_id, 10 + pitch % 3, CAST(floor(onset / 28) AS BIGINT), onset, pitch FROM anno),
sp AS (SELECT piece_id, motif, occ, count(*) AS n, min(onset) AS t0, max(onset) AS t1, max(onset) - min(onset) AS span FROM mo GROUP BY 1, 2, 3)"""
OVERLAPS = MOTIFS + """,
k AS (SELECT x.piece_id, x.motif AS ma, x.occ AS oa, y.motif AS mb, y.occ AS ob, count(*) AS shared FROM mo x JOIN mo y ON x.piece_id = y.piece_id AND x.onset = y.onset AND x.pitch = y.pitch AND x.motif < y.motif GROUP BY 1, 2, 3, 4, 5),
o AS (SELECT k.*, shared / (a.n + b.n - shared) AS jaccard, CASE WHEN greatest(a.t1, b.t1) > least(a.t0, b.t0) THEN greatest(0, least(a.t1, b.t1) - greatest(a.t0, b.t0)) / (greatest(a.t1, b.t1) - least(a.t0, b.t0)) ELSE 0 END AS iou
  FROM k JOIN sp a ON a.piece_id = k.piece_id AND a.motif = ma AND a.occ = oa JOIN sp b ON b.piece_id = k.piece_id AND b.motif = mb AND b.occ = ob),
bj AS (SELECT piece_id, ma, mb, jaccard, iou FROM (SELECT *, row_number() OVER (PARTITION BY piece_id, ma, mb ORDER BY jaccard DESC, iou DESC) AS q FROM o) WHERE q = 1),
bt AS (SELECT a.piece_id, a.motif AS ma, b.motif AS mb, max((least(a.t1, b.t1) - greatest(a.t0, b.t0)) / (greatest(a.t1, b.t1) - least(a.t0, b.t0))) AS iou FROM sp a JOIN sp b ON a.piece_id = b.piece_id AND a.motif < b.motif AND least(a.t1, b.t1) > greatest(a.t0, b.t0) GROUP BY 1, 2, 3),
bo AS (SELECT * FROM bj UNION ALL SELECT piece_id, ma, mb, 0, iou FROM bt WHERE NOT EXISTS (SELECT 1 FROM bj WHERE bj.piece_id = bt.piece_id AND bj.ma = bt.ma AND bj.mb = bt.mb))"""
SUMMARY = OVERLAPS + """,
mm AS (SELECT piece_id, motif, count(*) AS k, min(span) AS s0, avg(span) AS s, max(span) AS s1, min(n) AS n0, avg(n) AS n, max(n) AS n1 FROM sp GROUP BY 1, 2),
pm AS (SELECT piece_id, count(*) AS n_motifs, CAST(sum(k) AS BIGINT) AS n_occurrences, min(s0) AS min_span, avg(s) AS mean_span, max(s1) AS max_span, min(n0) AS min_notes, avg(n) AS mean_notes, max(n1) AS max_notes, count(*) FILTER (s1 / n >= 4.0) AS n_sparse FROM mm GROUP BY 1),
ap AS (SELECT x.piece_id, coalesce(jaccard, 0) AS jaccard, coalesce(iou, 0) AS iou FROM mm x JOIN mm y ON x.piece_id = y.piece_id AND x.motif < y.motif LEFT JOIN bo ON bo.piece_id = x.piece_id AND ma = x.motif AND mb = y.motif),
pa AS (SELECT piece_id, avg(jaccard) AS mj, avg(iou) AS mi, count(*) FILTER (jaccard >= 0.3 OR iou >= 0.3) AS nd, count(*) FILTER (jaccard >= 0.5 OR iou >= 0.5) AS ns FROM ap GROUP BY 1),
su AS (SELECT pm.*, coalesce(mj, 0) AS mean_jaccard, coalesce(mi, 0) AS mean_iou, coalesce(nd, 0) AS near_duplicates, coalesce(ns, 0) AS subset_pairs FROM pm LEFT JOIN pa USING (piece_id))"""
SCALE = "CASE WHEN {0} <= 4 THEN '4' WHEN {0} <= 8 THEN '8' WHEN {0} <= 16 THEN '16' WHEN {0} <= 24 THEN '24' ELSE '>24' END"

ORACLE = {
    "score_matrix": f"WITH {SETS}{MATRIX} SELECT piece_id, rp, ro, ep, eo, shared, nr, ne, round(score, 6) AS score FROM m",
    "establishment": f"WITH {SETS}{MATRIX}{EST} {PRF} FROM p JOIN r USING (piece_id)",
    "occurrence_metric": f"""WITH {SETS}{MATRIX}, q AS (SELECT piece_id, rp, ep FROM m GROUP BY 1, 2, 3 HAVING max(score) >= 0.5),
pp AS (SELECT piece_id, rp, ep, avg(x) AS p FROM (SELECT piece_id, rp, ep, eo, max(score) AS x FROM m GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
rr AS (SELECT piece_id, rp, ep, avg(x) AS r FROM (SELECT piece_id, rp, ep, ro, max(score) AS x FROM m GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
c AS (SELECT * FROM q JOIN pp USING (piece_id, rp, ep) JOIN rr USING (piece_id, rp, ep)),
pr AS (SELECT piece_id, avg(x) AS precision, avg(y) AS recall FROM (SELECT piece_id, max(p) OVER (PARTITION BY piece_id, ep) AS x, max(r) OVER (PARTITION BY piece_id, rp) AS y FROM c) GROUP BY 1),
al AS (SELECT DISTINCT m.piece_id, coalesce(precision, 0) AS precision, coalesce(recall, 0) AS recall FROM m LEFT JOIN pr USING (piece_id)) {PRF} FROM al""",
    "three_layer": f"WITH {SETS}{MATRIX}{LAYERS} {PRF} FROM f",
    "macro_means": f"WITH {SETS}{MATRIX}{LAYERS} SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, count(*) AS n_pieces FROM f",
    "first_five_establishment": f"WITH {SETS.replace('pitch % 5 AS pattern', 'pitch % 9 AS pattern').replace('est AS (', 'est0 AS (')}, rk AS (SELECT piece_id, pattern, row_number() OVER (PARTITION BY piece_id ORDER BY pattern) AS q FROM (SELECT DISTINCT piece_id, pattern FROM est0)), est AS (SELECT est0.* FROM est0 JOIN rk USING (piece_id, pattern) WHERE q <= 5){MATRIX}{EST} {PRF} FROM p JOIN r USING (piece_id)",
    "translational_metric": f"""WITH {SETS}, fr AS (SELECT piece_id, pattern, min(occ) AS occ FROM ref GROUP BY 1, 2), fe AS (SELECT piece_id, pattern, min(occ) AS occ FROM est GROUP BY 1, 2),
r0 AS (SELECT ref.*, min(onset) OVER w AS o0, first_value(pitch) OVER (w ORDER BY onset, pitch) AS p0 FROM ref JOIN fr USING (piece_id, pattern, occ) WINDOW w AS (PARTITION BY piece_id, pattern)),
e0 AS (SELECT est.*, min(onset) OVER w AS o0, first_value(pitch) OVER (w ORDER BY onset, pitch) AS p0 FROM est JOIN fe USING (piece_id, pattern, occ) WINDOW w AS (PARTITION BY piece_id, pattern)),
rf AS (SELECT piece_id, pattern, string_agg((onset - o0) || ':' || (pitch - p0), ' ' ORDER BY onset, pitch) AS form FROM r0 GROUP BY 1, 2),
ef AS (SELECT piece_id, pattern, string_agg((onset - o0) || ':' || (pitch - p0), ' ' ORDER BY onset, pitch) AS form FROM e0 GROUP BY 1, 2),
r AS (SELECT piece_id, avg(CASE WHEN EXISTS (SELECT 1 FROM ef WHERE ef.piece_id = rf.piece_id AND ef.form = rf.form) THEN 1.0 ELSE 0 END) AS recall FROM rf GROUP BY 1),
p AS (SELECT piece_id, avg(CASE WHEN EXISTS (SELECT 1 FROM rf WHERE ef.piece_id = rf.piece_id AND ef.form = rf.form) THEN 1.0 ELSE 0 END) AS precision FROM ef GROUP BY 1)
SELECT piece_id, round(recall, 6) AS recall, round(coalesce(precision, 0), 6) AS precision FROM r LEFT JOIN p USING (piece_id)""",
    "best_piece": f"WITH {SETS}{MATRIX}{LAYERS} SELECT piece_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f ORDER BY round(f.f1, 9) DESC, piece_id LIMIT 1",
    "piece_audit": f"WITH {SUMMARY} SELECT piece_id, n_motifs, n_occurrences, min_span, round(mean_span, 6) AS mean_span, max_span, min_notes, round(mean_notes, 6) AS mean_notes, max_notes, n_sparse, round(mean_jaccard, 6) AS mean_jaccard, round(mean_iou, 6) AS mean_iou, near_duplicates, subset_pairs FROM su",
    "audit_totals": f"WITH {SUMMARY} SELECT count(*) AS n_pieces, round(avg(n_motifs), 6) AS n_motifs, round(avg(n_occurrences), 6) AS n_occurrences, round(avg(mean_jaccard), 6) AS mean_jaccard, round(avg(mean_iou), 6) AS mean_iou, CAST(sum(near_duplicates) AS BIGINT) AS near_duplicates, CAST(sum(subset_pairs) AS BIGINT) AS subset_pairs, CAST(sum(n_sparse) AS BIGINT) AS n_sparse FROM su",
    "best_motif_overlap": f"WITH {OVERLAPS} SELECT piece_id, ma, mb, round(jaccard, 6) AS jaccard, round(iou, 6) AS iou FROM bo",
    "within_motif_overlap": f"""WITH {MOTIFS}, d AS (SELECT * FROM mo UNION ALL SELECT piece_id, motif, 100 + CAST(floor(onset / 20) AS BIGINT), onset, pitch FROM mo),
n AS (SELECT *, row_number() OVER (PARTITION BY piece_id, motif ORDER BY n DESC, occ) AS q FROM (SELECT piece_id, motif, occ, count(*) AS n FROM d GROUP BY 1, 2, 3)),
x AS (SELECT d.*, n.n FROM d JOIN n USING (piece_id, motif, occ) WHERE q <= 6),
j AS (SELECT a.piece_id, a.motif, a.occ AS oa, b.occ AS ob, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS j FROM x a JOIN x b USING (piece_id, motif, onset, pitch) WHERE a.occ < b.occ GROUP BY 1, 2, 3, 4),
c AS (SELECT piece_id, motif, count(*) * (count(*) - 1) / 2 AS pairs FROM n WHERE q <= 6 GROUP BY 1, 2)
SELECT c.piece_id, c.motif, round(coalesce(sum(j), 0) / any_value(pairs), 6) AS mean_jaccard, round(coalesce(max(j), 0), 6) AS max_jaccard FROM c LEFT JOIN j USING (piece_id, motif) WHERE pairs > 0 GROUP BY 1, 2""",
    "within_motif_audit": f"""WITH {MOTIFS}, d AS (SELECT * FROM mo UNION ALL SELECT piece_id, motif, 100 + CAST(floor(onset / 20) AS BIGINT), onset, pitch FROM mo),
n AS (SELECT *, row_number() OVER (PARTITION BY piece_id, motif ORDER BY n DESC, occ) AS q FROM (SELECT piece_id, motif, occ, count(*) AS n, min(onset) AS t0, max(onset) AS t1 FROM d GROUP BY 1, 2, 3)),
x AS (SELECT d.*, n.n FROM d JOIN n USING (piece_id, motif, occ) WHERE q <= 50),
j AS (SELECT a.piece_id, a.motif, a.occ AS oa, b.occ AS ob, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS j FROM x a JOIN x b USING (piece_id, motif, onset, pitch) WHERE a.occ < b.occ GROUP BY 1, 2, 3, 4),
t AS (SELECT a.piece_id, a.motif, a.occ AS oa, b.occ AS ob, CASE WHEN greatest(a.t1, b.t1) > least(a.t0, b.t0) THEN greatest(0, least(a.t1, b.t1) - greatest(a.t0, b.t0)) / (greatest(a.t1, b.t1) - least(a.t0, b.t0)) ELSE 0 END AS iou
  FROM n a JOIN n b USING (piece_id, motif) WHERE a.q <= 50 AND b.q <= 50 AND a.occ < b.occ)
SELECT piece_id, motif, round(avg(coalesce(j, 0)), 6) AS mean_jaccard, round(max(coalesce(j, 0)), 6) AS max_jaccard, round(avg(iou), 6) AS mean_iou, round(max(iou), 6) AS max_iou FROM t LEFT JOIN j USING (piece_id, motif, oa, ob) GROUP BY 1, 2""",
    "note_coverage": f"""WITH {MOTIFS}, t AS (SELECT piece_id, onset, pitch, count(*) AS times FROM mo WHERE motif IN (1, 2, 11) GROUP BY 1, 2, 3)
SELECT a.piece_id, round(avg(CASE WHEN times IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS coverage, round(coalesce(avg(times), 0), 6) AS multiplicity FROM (SELECT DISTINCT piece_id, onset, pitch FROM anno) a LEFT JOIN t USING (piece_id, onset, pitch) GROUP BY 1""",
    "span_bins": f"""WITH {MOTIFS}, a AS (SELECT {SCALE.format('span')} AS scale, count(*) AS n_occurrences FROM sp GROUP BY 1), md AS (SELECT piece_id, motif, quantile_cont(span, 0.5) AS q FROM sp GROUP BY 1, 2), b AS (SELECT {SCALE.format('q')} AS scale, count(*) AS n_motifs FROM md GROUP BY 1)
SELECT coalesce(a.scale, b.scale) AS scale, coalesce(n_occurrences, 0) AS n_occurrences, coalesce(n_motifs, 0) AS n_motifs FROM a FULL JOIN b ON a.scale = b.scale""",
    "representative_occurrences": f"WITH {MOTIFS} SELECT piece_id, motif, occ, n AS n_notes, span FROM (SELECT *, row_number() OVER (PARTITION BY piece_id, motif ORDER BY n DESC, span, occ) AS q FROM sp) WHERE q = 1",
    "price_percentiles": "SELECT CAST(p_size AS BIGINT) AS p_size, round(min(v), 4) AS min, " + ", ".join(f"round(quantile_cont(v, {p / 100}), 4) AS p{p}" for p in au.PERCENTS) + ", round(max(v), 4) AS max, round(avg(v), 4) AS mean FROM (SELECT p_size, CAST(p_retailprice AS DOUBLE) AS v FROM part) GROUP BY 1",
    "price_histogram": "SELECT least(19, greatest(0, CAST(floor(CAST(o_totalprice AS DOUBLE) / 25000.0) AS BIGINT))) AS bin, count(*) AS n FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1",
    "label_similarity": """WITH x AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS k FROM embeddings WHERE embedding IS NOT NULL),
o AS (SELECT label, sum(v * v) AS own, count(DISTINCT vec_id) AS n FROM x GROUP BY 1), t AS (SELECT label, sum(s * s) AS s2 FROM (SELECT label, k, sum(v) AS s FROM x GROUP BY 1, 2) GROUP BY 1)
SELECT CAST(label AS BIGINT) AS label, n, round((s2 - own) / (n * (n - 1)), 5) AS mean_similarity FROM o JOIN t USING (label) WHERE n > 1""",
    "span_iou_pairs": f"""WITH {MOTIFS}, l AS (SELECT piece_id, t0, t1 + 14 AS t1, lead(t0) OVER w AS u0, lead(t1) OVER w + 14 AS u1 FROM sp WINDOW w AS (PARTITION BY piece_id, motif ORDER BY occ))
SELECT piece_id, round(avg(greatest(0, least(t1, u1) - greatest(t0, u0)) / (greatest(t1, u1) - least(t0, u0))), 6) AS mean_iou FROM l WHERE u0 IS NOT NULL GROUP BY 1""",
    "toxic_confusion": """WITH c AS (SELECT CAST(sum(CASE WHEN toxic = 1 AND quality = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN toxic <> 1 AND quality = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN toxic = 1 AND quality <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN toxic <> 1 AND quality <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
r AS (SELECT *, (tp + tn) / greatest(tp + fp + fn + tn, 1) AS accuracy, tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall FROM c)
SELECT tp, fp, fn, tn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM r""",
    "class_confusion": "SELECT CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic, count(*) AS n FROM labels GROUP BY 1, 2",
    "fold_statistics": "WITH a AS (SELECT doc_id % 5 AS fold, avg(CASE WHEN (toxic = 1) = (quality = 0) THEN 1.0 ELSE 0 END) AS a FROM labels GROUP BY 1) SELECT round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS deviation FROM a",
}
