"""Queries of the translational pattern operators over the notes view, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import vec
from ..operators import geometry as g
from ..operators.graph import in_parts
from ..session import NOTES_SQL, notes_view

LEAST_CR = 1.2


def text(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda p: F.concat_ws(":", p["onset"], p["pitch"])), " ")


def sia_mtp(spark: SparkSession, d: str) -> DataFrame:
    return g.mtps(notes_view(spark, d)).select("piece_id", "d_onset", "d_pitch", "size", text(F.col("pattern")).alias("pattern"))


def mtp_properties(spark: SparkSession, d: str) -> DataFrame:
    """Number and sizes of each piece's MTPs, with the number of points, which bounds them."""
    notes = notes_view(spark, d)
    out = g.mtps(notes).groupBy("piece_id").agg(F.count(F.lit(1)).alias("n_mtps"), F.max("size").cast("long").alias("max_size"), F.round(F.avg("size"), 6).alias("avg_size"))
    return out.join(notes.groupBy("piece_id").agg(F.count(F.lit(1)).alias("n_points")), "piece_id")


def mtp_cis_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the groups of all vectors, zero and negative ones included."""
    return g.all_mtps(notes_view(spark, d)).groupBy("piece_id", F.col("size").cast("long").alias("size")).agg(F.count(F.lit(1)).alias("n_vectors"))


def siar_mtp(spark: SparkSession, d: str) -> DataFrame:
    return g.siar(notes_view(spark, d), 3).select("piece_id", "d_onset", "d_pitch", "freq", text(F.col("pattern")).alias("pattern"))


def vectorised_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Each MTP's steps from point to point, by length."""
    found = g.mtps(notes_view(spark, d)).where("size >= 3")
    return found.select("piece_id", "d_onset", "d_pitch", F.col("size").cast("long").alias("size"), text(vec(F.col("pattern"))).alias("steps"))


def siatec_tecs(spark: SparkSession, d: str) -> DataFrame:
    tecs = g.siatec(notes_view(spark, d))
    return tecs.select("piece_id", "d_onset", "d_pitch", text(F.col("pattern")).alias("pattern"), F.col("n_translators").cast("long").alias("n_translators"), text(F.col("translators")).alias("translators"))


def _measured(notes: DataFrame) -> DataFrame:
    return g.measured(g.siatec(notes), notes)


def tec_measures(spark: SparkSession, d: str) -> DataFrame:
    out = in_parts(notes_view(spark, d), lambda notes: _measured(notes).drop("pattern", "shape", "translators"))
    return out.select("piece_id", "d_onset", "d_pitch", F.col("size").cast("long").alias("size"), "coverage", F.round("cr", 6).alias("cr"), F.round("compactness", 6).alias("compactness"), "width", "volume")


def siatech_pf(spark: SparkSession, d: str) -> DataFrame:
    return in_parts(notes_view(spark, d), lambda notes: g.siatech_pf(notes, LEAST_CR).select("piece_id", "d_onset", "d_pitch", "coverage", F.round("cr", 6).alias("cr")))


def siatechf(spark: SparkSession, d: str) -> DataFrame:
    return in_parts(notes_view(spark, d), lambda notes: g.siatechf(notes, LEAST_CR).select("piece_id", "d_onset", "d_pitch", "coverage", F.round("cr", 6).alias("cr")))


def cr_statistics(spark: SparkSession, d: str) -> DataFrame:
    def of(notes: DataFrame) -> DataFrame:
        return _measured(notes).groupBy("piece_id").agg(F.round(F.min("cr"), 6).alias("min_cr"), F.round(F.max("cr"), 6).alias("max_cr"), F.round(F.avg("cr"), 6).alias("avg_cr"), F.count(F.lit(1)).alias("n_tecs"))

    return in_parts(notes_view(spark, d), of)


def tec_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The best ten TECs of each piece."""
    return in_parts(notes_view(spark, d), lambda notes: g.ranked(_measured(notes)).where("rank <= 10").select("piece_id", F.col("rank").cast("long").alias("rank"), "d_onset", "d_pitch", F.round("cr", 6).alias("cr")))


def tec_conjugates(spark: SparkSession, d: str) -> DataFrame:
    return g.conjugate(g.siatec(notes_view(spark, d)).where("size >= 2")).select("piece_id", "d_onset", "d_pitch", text(F.col("pattern")).alias("pattern"), text(F.col("translators")).alias("translators"))


def tec_salience(spark: SparkSession, d: str) -> DataFrame:
    def of(notes: DataFrame) -> DataFrame:
        return g.salience(_measured(notes), notes).select("piece_id", "d_onset", "d_pitch", F.round("max_compactness", 6).alias("max_compactness"), F.round("salience", 5).alias("salience"))

    return in_parts(notes_view(spark, d), of)


def covered_sets(spark: SparkSession, d: str) -> DataFrame:
    """How many TECs of a piece cover the same set of points: equal coverage is how classes are compared."""
    cover = g.covered(g.siatec(notes_view(spark, d))).groupBy("piece_id", "d_onset", "d_pitch").agg(text(F.sort_array(F.collect_list(g.point()))).alias("points"))
    return cover.groupBy("piece_id", "points").agg(F.count(F.lit(1)).alias("n_tecs"))


def tec_membership(spark: SparkSession, d: str) -> DataFrame:
    """Share of each piece's TECs whose size, number of translators and coverage also occur among those of the filtered algorithm."""

    def of(notes: DataFrame) -> DataFrame:
        tecs = _measured(notes).select("piece_id", "size", "n_translators", "coverage")
        other = g.siatechf(notes, LEAST_CR).select("piece_id", "size", "n_translators", "coverage").distinct().withColumn("found", F.lit(1))
        return tecs.join(other, ["piece_id", "size", "n_translators", "coverage"], "left").groupBy("piece_id").agg(F.round(F.avg(F.coalesce("found", F.lit(0))), 6).alias("share"))

    return in_parts(notes_view(spark, d), of)


def occurrences(spark: SparkSession, d: str) -> DataFrame:
    """All occurrences of each piece's best TEC, point by point."""

    def of(notes: DataFrame) -> DataFrame:
        best = g.ranked(_measured(notes)).where("rank = 1")
        t = best.select("piece_id", "pattern", F.explode("translators").alias("t"))
        out = t.select("piece_id", F.col("t.onset").alias("t_onset"), F.col("t.pitch").alias("t_pitch"), F.explode("pattern").alias("p"))
        return out.select("piece_id", "t_onset", "t_pitch", (F.col("p.onset") + F.col("t_onset")).alias("onset"), (F.col("p.pitch") + F.col("t_pitch")).alias("pitch"))

    return in_parts(notes_view(spark, d), of)


def cardinality_scores(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 20 steps of a piece against each other, up to translation."""
    sets = notes_view(spark, d).withColumn("w", F.floor(F.col("onset") / 20)).select("piece_id", F.concat_ws("/", "piece_id", "w").alias("set_id"), "onset", "pitch")
    return g.cardinality(sets, sets, translate=True).where("p_id < q_id").select("p_id", "q_id", F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (sia_mtp, mtp_properties, mtp_cis_pairs, siar_mtp, vectorised_patterns, siatec_tecs, tec_measures, siatech_pf, siatechf, cr_statistics, tec_ranking, tec_conjugates, tec_salience, covered_sets, tec_membership, occurrences, cardinality_scores)}

PAIRS = NOTES_SQL + """,
pairs AS (SELECT a.piece_id, b.onset - a.onset AS d_onset, b.pitch - a.pitch AS d_pitch, a.onset, a.pitch
  FROM notes a JOIN notes b ON a.piece_id = b.piece_id AND (a.onset < b.onset OR a.onset = b.onset AND a.pitch < b.pitch)),
mtp AS (SELECT piece_id, d_onset, d_pitch, count(*) AS size, string_agg(onset || ':' || pitch, ' ' ORDER BY onset, pitch) AS pattern,
  min(onset) AS o0, arg_min(pitch, onset * 1000 + pitch) AS p0 FROM pairs GROUP BY 1, 2, 3)"""
TECS = PAIRS + """,
pts AS (SELECT p.*, m.size, m.o0, m.p0, m.pattern FROM pairs p JOIN mtp m USING (piece_id, d_onset, d_pitch)),
shapes AS (SELECT piece_id, d_onset, d_pitch, any_value(size) AS size, any_value(pattern) AS pattern,
  string_agg((onset - o0) || ':' || (pitch - p0), ' ' ORDER BY onset, pitch) AS shape FROM pts GROUP BY 1, 2, 3),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY piece_id, shape ORDER BY d_onset, d_pitch) AS k FROM shapes) WHERE k = 1),
tp AS (SELECT p.piece_id, p.d_onset, p.d_pitch, p.onset, p.pitch, p.size FROM pts p JOIN one USING (piece_id, d_onset, d_pitch)),
trans AS (SELECT t.piece_id, t.d_onset, t.d_pitch, n.onset - t.onset AS t_onset, n.pitch - t.pitch AS t_pitch
  FROM tp t JOIN notes n USING (piece_id) GROUP BY 1, 2, 3, 4, 5 HAVING count(*) = any_value(t.size)),
tec AS (SELECT o.piece_id, o.d_onset, o.d_pitch, o.size, o.pattern, o.shape, count(*) AS n_translators,
  string_agg(t_onset || ':' || t_pitch, ' ' ORDER BY t_onset, t_pitch) AS translators
  FROM one o JOIN trans USING (piece_id, d_onset, d_pitch) GROUP BY 1, 2, 3, 4, 5, 6)"""
COVER = TECS + """,
cover AS (SELECT DISTINCT p.piece_id, p.d_onset, p.d_pitch, p.onset + t.t_onset AS onset, p.pitch + t.t_pitch AS pitch FROM tp p JOIN trans t USING (piece_id, d_onset, d_pitch))"""
MEASURES = COVER + """,
cov AS (SELECT piece_id, d_onset, d_pitch, count(*) AS coverage FROM cover GROUP BY 1, 2, 3),
box AS (SELECT piece_id, d_onset, d_pitch, min(onset) AS a0, max(onset) AS a1, min(pitch) AS b0, max(pitch) AS b1 FROM tp GROUP BY 1, 2, 3),
inb AS (SELECT b.piece_id, b.d_onset, b.d_pitch, count(*) AS in_box FROM box b JOIN notes n ON n.piece_id = b.piece_id AND n.onset BETWEEN a0 AND a1 AND n.pitch BETWEEN b0 AND b1 GROUP BY 1, 2, 3),
m AS (SELECT t.*, coverage, coverage / (size + n_translators - 1) AS cr, size / in_box AS compactness, a1 - a0 AS width, (a1 - a0) * (b1 - b0) AS volume
  FROM tec t JOIN cov USING (piece_id, d_onset, d_pitch) JOIN box USING (piece_id, d_onset, d_pitch) JOIN inb USING (piece_id, d_onset, d_pitch)),
best AS (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY cr DESC, compactness DESC, coverage DESC, size DESC, width, volume, d_onset, d_pitch) AS rank FROM m)"""
SALIENT = """si AS (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY onset, pitch) AS idx FROM notes),
pos AS (SELECT p.piece_id, p.d_onset, p.d_pitch, t.t_onset, t.t_pitch, max(si.idx) - min(si.idx) + 1 AS span, any_value(p.size) AS size FROM tp p JOIN trans t USING (piece_id, d_onset, d_pitch) JOIN si ON si.piece_id = p.piece_id AND si.onset = p.onset + t.t_onset AND si.pitch = p.pitch + t.t_pitch GROUP BY 1, 2, 3, 4, 5),
mc AS (SELECT piece_id, d_onset, d_pitch, max(size / span) AS c FROM pos GROUP BY 1, 2, 3),
sj AS (SELECT m.piece_id, m.d_onset, m.d_pitch, cr, c, min(cr) OVER w AS r0, max(cr) OVER w AS r1, min(c) OVER w AS c0, max(c) OVER w AS c1 FROM m JOIN mc USING (piece_id, d_onset, d_pitch) WINDOW w AS (PARTITION BY m.piece_id)),
sal AS (SELECT piece_id, d_onset, d_pitch, c, (CASE WHEN r1 > r0 THEN (cr - r0) / (r1 - r0) ELSE 0 END) * (CASE WHEN c1 > c0 THEN (c - c0) / (c1 - c0) ELSE 0 END) AS salience FROM sj)"""
FILTERED = f"WITH {MEASURES} SELECT piece_id, d_onset, d_pitch, coverage, round(cr, 6) AS cr FROM m WHERE cr >= {LEAST_CR}"

ORACLE = {
    "sia_mtp": f"WITH {PAIRS} SELECT piece_id, d_onset, d_pitch, CAST(size AS INTEGER) AS size, pattern FROM mtp",
    "mtp_properties": f"WITH {PAIRS} SELECT piece_id, count(*) AS n_mtps, max(size) AS max_size, round(avg(size), 6) AS avg_size, (SELECT count(*) FROM notes n WHERE n.piece_id = mtp.piece_id) AS n_points FROM mtp GROUP BY piece_id",
    "mtp_cis_pairs": f"WITH {NOTES_SQL} SELECT piece_id, size, count(*) AS n_vectors FROM (SELECT a.piece_id, b.onset - a.onset AS x, b.pitch - a.pitch AS y, count(*) AS size FROM notes a JOIN notes b USING (piece_id) GROUP BY 1, 2, 3) GROUP BY 1, 2",
    "siar_mtp": f"""WITH {NOTES_SQL},
x AS (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY onset, pitch) AS i FROM notes),
band AS (SELECT a.piece_id, a.onset, a.pitch, b.onset - a.onset AS v, b.pitch - a.pitch AS u FROM x a JOIN x b ON a.piece_id = b.piece_id AND b.i BETWEEN a.i + 1 AND a.i + 3),
vs AS (SELECT a.piece_id, b.onset - a.onset AS d_onset, b.pitch - a.pitch AS d_pitch, count(*) AS freq FROM band a JOIN band b ON a.piece_id = b.piece_id AND a.u = b.u AND a.v = b.v AND (a.onset < b.onset OR a.onset = b.onset AND a.pitch < b.pitch) GROUP BY 1, 2, 3)
SELECT s.piece_id, s.d_onset, s.d_pitch, any_value(s.freq) AS freq, string_agg(a.onset || ':' || a.pitch, ' ' ORDER BY a.onset, a.pitch) AS pattern
FROM vs s JOIN notes a USING (piece_id) JOIN notes b ON b.piece_id = a.piece_id AND b.onset = a.onset + s.d_onset AND b.pitch = a.pitch + s.d_pitch GROUP BY 1, 2, 3""",
    "vectorised_patterns": f"""WITH {PAIRS}, l AS (SELECT *, lag(onset) OVER w AS po, lag(pitch) OVER w AS pp, count(*) OVER (PARTITION BY piece_id, d_onset, d_pitch) AS size FROM pairs WINDOW w AS (PARTITION BY piece_id, d_onset, d_pitch ORDER BY onset, pitch))
SELECT piece_id, d_onset, d_pitch, size, string_agg((onset - po) || ':' || (pitch - pp), ' ' ORDER BY onset, pitch) AS steps FROM l WHERE size >= 3 AND po IS NOT NULL GROUP BY 1, 2, 3, 4""",
    "siatec_tecs": f"WITH {TECS} SELECT piece_id, d_onset, d_pitch, pattern, n_translators, translators FROM tec",
    "tec_measures": f"WITH {MEASURES} SELECT piece_id, d_onset, d_pitch, size, coverage, round(cr, 6) AS cr, round(compactness, 6) AS compactness, width, volume FROM m",
    "siatech_pf": FILTERED,
    "siatechf": FILTERED,
    "cr_statistics": f"WITH {MEASURES} SELECT piece_id, round(min(cr), 6) AS min_cr, round(max(cr), 6) AS max_cr, round(avg(cr), 6) AS avg_cr, count(*) AS n_tecs FROM m GROUP BY 1",
    "tec_ranking": f"WITH {MEASURES} SELECT piece_id, rank, d_onset, d_pitch, round(cr, 6) AS cr FROM best WHERE rank <= 10",
    "tec_conjugates": f"""WITH {TECS}, f AS (SELECT piece_id, d_onset, d_pitch, min(onset) AS o0, arg_min(pitch, onset * 1000 + pitch) AS p0 FROM tp GROUP BY 1, 2, 3)
SELECT t.piece_id, t.d_onset, t.d_pitch, string_agg((o0 + t_onset) || ':' || (p0 + t_pitch), ' ' ORDER BY t_onset, t_pitch) AS pattern, any_value(o.shape) AS translators
FROM trans t JOIN f USING (piece_id, d_onset, d_pitch) JOIN one o USING (piece_id, d_onset, d_pitch) WHERE o.size >= 2 GROUP BY 1, 2, 3""",
    "tec_salience": f"WITH {MEASURES}, {SALIENT} SELECT piece_id, d_onset, d_pitch, round(c, 6) AS max_compactness, round(salience, 5) AS salience FROM sal",
    "covered_sets": f"WITH {COVER}, s AS (SELECT piece_id, d_onset, d_pitch, string_agg(onset || ':' || pitch, ' ' ORDER BY onset, pitch) AS points FROM cover GROUP BY 1, 2, 3) SELECT piece_id, points, count(*) AS n_tecs FROM s GROUP BY 1, 2",
    "tec_membership": f"WITH {MEASURES} SELECT a.piece_id, round(avg(CASE WHEN EXISTS (SELECT 1 FROM m b WHERE b.cr >= {LEAST_CR} AND b.piece_id = a.piece_id AND b.size = a.size AND b.n_translators = a.n_translators AND b.coverage = a.coverage) THEN 1 ELSE 0 END), 6) AS share FROM m a GROUP BY 1",
    "occurrences": f"WITH {MEASURES} SELECT t.piece_id, t.t_onset, t.t_pitch, p.onset + t.t_onset AS onset, p.pitch + t.t_pitch AS pitch FROM best b JOIN tp p USING (piece_id, d_onset, d_pitch) JOIN trans t USING (piece_id, d_onset, d_pitch) WHERE b.rank = 1",
    "cardinality_scores": f"""WITH {NOTES_SQL}, s AS (SELECT piece_id, piece_id || '/' || CAST(floor(onset / 20) AS BIGINT) AS id, onset, pitch FROM notes), n AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.id AS p_id, b.id AS q_id, count(*) AS k FROM s a JOIN s b ON a.piece_id = b.piece_id AND a.id < b.id GROUP BY 1, 2, b.onset - a.onset, b.pitch - a.pitch)
SELECT p_id, q_id, round(max(k) / greatest(any_value(x.n), any_value(y.n)), 6) AS score FROM c JOIN n x ON x.id = p_id JOIN n y ON y.id = q_id GROUP BY 1, 2""",
}
