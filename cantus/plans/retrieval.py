"""Queries of windows, n-gram vectors, similarity graphs and motifs over the notes view, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval as r
from ..operators.graph import in_parts, written
from ..session import NOTES_SQL, notes_view

CFG = r.Config()
TOP = r.Config(top_k=5, similarity=0.6)


def _members(spark: SparkSession, d: str) -> DataFrame:
    return r.membership(notes_view(spark, d), CFG)


def _sims(spark: SparkSession, d: str, cfg: r.Config = CFG) -> tuple[DataFrame, DataFrame]:
    members = _members(spark, d)
    return r.similarities(r.vectors(r.steps(members), cfg), cfg), r.segments(members)


def segment_windows(spark: SparkSession, d: str) -> DataFrame:
    return r.segments(_members(spark, d)).select("piece_id", F.col("seg").cast("long").alias("seg"), F.col("scale").cast("long").alias("scale"), "start", "end", "n_notes")


def segment_counts(spark: SparkSession, d: str) -> DataFrame:
    return r.segments(_members(spark, d)).groupBy("piece_id", F.col("scale").cast("long").alias("scale")).agg(F.count(F.lit(1)).alias("n_segments"), F.sum("n_notes").alias("n_notes"))


def segment_steps(spark: SparkSession, d: str) -> DataFrame:
    return r.steps(_members(spark, d)).select("piece_id", F.col("seg").cast("long").alias("seg"), F.col("i").cast("long").alias("i"), "d_pitch", "d_time")


def ngram_vectors(spark: SparkSession, d: str) -> DataFrame:
    return r.vectors(r.steps(_members(spark, d)), CFG).select("piece_id", F.col("seg").cast("long").alias("seg"), "bucket", F.round("weight", 6).alias("weight"))


def similarity_edges(spark: SparkSession, d: str) -> DataFrame:
    sims, segs = _sims(spark, d)
    return r.edges(sims, segs, CFG).select("piece_id", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.round("sim", 4).alias("sim"))


def top_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """How many edges each piece has where similarity or a place among the five nearest makes one."""

    def of(notes: DataFrame) -> DataFrame:
        _, segs, sims = r.compared(notes, TOP)
        return r.edges(sims, segs, TOP).groupBy("piece_id").agg(F.count(F.lit(1)).alias("n_edges"))

    return in_parts(notes_view(spark, d), of)


def segment_components(spark: SparkSession, d: str) -> DataFrame:
    sims, segs = _sims(spark, d)
    return r.clusters(written(r.edges(sims, segs, CFG))).select("piece_id", F.col("seg").cast("long").alias("seg"), F.col("component").cast("long").alias("component"))


def segment_centrality(spark: SparkSession, d: str) -> DataFrame:
    sims, segs = _sims(spark, d)
    sims = written(sims)
    out = r.centrality(r.clusters(r.edges(sims, segs, CFG)), sims)
    return out.select("piece_id", F.col("seg").cast("long").alias("seg"), F.round("score", 4).alias("score"))


def retrieval_sweep(spark: SparkSession, d: str) -> DataFrame:
    sims, segs = _sims(spark, d)
    return r.sweep(sims, segs, (0.7, 0.8, 0.9), (0.25, 1.1))


def retrieved_motifs(spark: SparkSession, d: str) -> DataFrame:
    return r.predict(notes_view(spark, d), CFG)


def retrieval_subgraph(spark: SparkSession, d: str) -> DataFrame:
    sims, segs = _sims(spark, d)
    graph = written(r.edges(sims, segs, CFG))
    return r.subgraph(graph, r.clusters(graph)).groupBy("piece_id", "inner").agg(F.count(F.lit(1)).alias("n_edges"))


QUERIES = {f.__name__: f for f in (segment_windows, segment_counts, segment_steps, ngram_vectors, similarity_edges, top_neighbours, segment_components, segment_centrality, retrieval_sweep, retrieved_motifs, retrieval_subgraph)}

SEGMENTS = NOTES_SQL + """,
ends AS (SELECT piece_id, min(onset) AS o0, max(onset) AS o1 FROM notes GROUP BY 1),
scales AS (SELECT * FROM (VALUES (0, 8, 2), (1, 16, 4)) t(scale_no, scale, step)),
wins AS (SELECT piece_id, scale_no, scale, unnest(generate_series(o0, o1, step)) AS start FROM ends, scales),
mem AS (SELECT w.*, n.onset, n.pitch FROM wins w JOIN notes n ON n.piece_id = w.piece_id AND n.onset >= w.start AND n.onset < w.start + w.scale),
kept AS (SELECT piece_id, scale_no, scale, start, count(*) AS n_notes, row_number() OVER (PARTITION BY piece_id ORDER BY scale_no, start) - 1 AS seg FROM mem GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3),
m AS (SELECT k.piece_id, k.seg, k.scale, k.start, mem.onset, mem.pitch FROM kept k JOIN mem USING (piece_id, scale_no, start))"""
STEPS = SEGMENTS + """,
s0 AS (SELECT piece_id, seg, scale, row_number() OVER w AS i, pitch - lag(pitch) OVER w AS d_pitch, ln(greatest(onset - lag(onset) OVER w, 1e-4)) AS t, lag(onset) OVER w AS po FROM m WINDOW w AS (PARTITION BY piece_id, seg ORDER BY onset, pitch)),
s1 AS (SELECT *, round(avg(t) OVER (PARTITION BY piece_id, seg), 9) AS g FROM s0 WHERE po IS NOT NULL),
st AS (SELECT piece_id, seg, scale, i, d_pitch, round(t - g, 6) AS d_time, g FROM s1)"""


def _bins(x: str, edges: tuple) -> str:
    return " + ".join(f"CAST({x} >= {e} AS INTEGER)" for e in edges[1:-1])


def _hash(first: int, tokens: list[str], shift: int) -> str:
    h = f"CAST({first} AS BIGINT)"
    for t in tokens:
        h = f"(({h} * 1000003 + {t}) % 2147483647)"
    return f"{h} % 256 + {shift}"


VECTORS = STEPS + f""",
tok AS (SELECT *, ({_bins('d_pitch', CFG.pitch_bins)}) * 32 + ({_bins('d_time', CFG.time_bins)}) AS t0 FROM st),
tk AS (SELECT *, lead(t0) OVER w AS t1, lead(t0, 2) OVER w AS t2 FROM tok WINDOW w AS (PARTITION BY piece_id, seg ORDER BY i)),
gr AS (SELECT piece_id, seg, scale, g, {_hash(2, ['t0', 't1'], 0)} AS bucket FROM tk WHERE t1 IS NOT NULL
  UNION ALL SELECT piece_id, seg, scale, g, {_hash(3, ['t0', 't2'], 0)} FROM tk WHERE t2 IS NOT NULL
  UNION ALL SELECT piece_id, seg, scale, g, {_hash(3, ['t0', 't1', 't2'], 256)} FROM tk WHERE t2 IS NOT NULL),
cn AS (SELECT piece_id, seg, scale, g, bucket, count(*) AS n FROM gr GROUP BY ALL),
v AS (SELECT piece_id, seg, scale, g, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY piece_id, seg)) AS weight FROM cn)"""
EDGES = VECTORS + """,
sims AS (SELECT a.piece_id, a.seg AS a, b.seg AS b, sum(a.weight * b.weight) * exp(-1.0 * abs(any_value(a.g) - any_value(b.g))) AS sim FROM v a JOIN v b ON a.piece_id = b.piece_id AND a.scale = b.scale AND a.bucket = b.bucket AND a.seg < b.seg GROUP BY 1, 2, 3),
sp AS (SELECT s.piece_id, s.a, s.b, round(s.sim, 6) AS sim, greatest(0, least(x.start + x.scale, y.start + y.scale) - greatest(x.start, y.start)) / (greatest(x.start + x.scale, y.start + y.scale) - least(x.start, y.start)) AS iou
  FROM sims s JOIN kept x ON x.piece_id = s.piece_id AND x.seg = s.a JOIN kept y ON y.piece_id = s.piece_id AND y.seg = s.b),
e AS (SELECT piece_id, a, b, sim FROM sp WHERE sim >= 0.9 AND iou < 0.25)"""
RANKED = VECTORS + """,
si AS (SELECT a.piece_id, a.seg AS a, b.seg AS b, round(sum(a.weight * b.weight) * exp(-1.0 * abs(any_value(a.g) - any_value(b.g))), 6) AS sim FROM v a JOIN v b ON a.piece_id = b.piece_id AND a.bucket = b.bucket AND a.seg <> b.seg GROUP BY 1, 2, 3),
al AS (SELECT x.piece_id, x.seg AS a, y.seg AS b, coalesce(si.sim, 0) AS sim, x.scale = y.scale AS same, greatest(0, least(x.start + x.scale, y.start + y.scale) - greatest(x.start, y.start)) / (greatest(x.start + x.scale, y.start + y.scale) - least(x.start, y.start)) AS iou
  FROM kept x JOIN kept y ON x.piece_id = y.piece_id AND x.seg <> y.seg LEFT JOIN si ON si.piece_id = x.piece_id AND si.a = x.seg AND si.b = y.seg),
ra AS (SELECT *, row_number() OVER (PARTITION BY piece_id, a ORDER BY sim DESC, b) AS rank FROM al),
nb AS (SELECT piece_id, least(a, b) AS a, greatest(a, b) AS b, max(sim) AS sim, any_value(same) AS same, any_value(iou) AS iou, min(rank) AS rank FROM ra GROUP BY 1, 2, 3)"""
COMPONENTS = EDGES + """,
u AS (SELECT piece_id, a AS x, b AS y FROM e UNION SELECT piece_id, b, a FROM e),
reach AS (SELECT piece_id, x, x AS r FROM u UNION SELECT reach.piece_id, u.y, reach.r FROM reach JOIN u ON u.piece_id = reach.piece_id AND u.x = reach.x),
comp AS (SELECT piece_id, x AS seg, min(r) AS component FROM reach GROUP BY 1, 2)"""

ORACLE = {
    "segment_windows": f"WITH {SEGMENTS} SELECT piece_id, seg, CAST(scale AS BIGINT) AS scale, start, start + scale AS \"end\", n_notes FROM kept",
    "segment_counts": f"WITH {SEGMENTS} SELECT piece_id, CAST(scale AS BIGINT) AS scale, count(*) AS n_segments, CAST(sum(n_notes) AS BIGINT) AS n_notes FROM kept GROUP BY 1, 2",
    "segment_steps": f"WITH {STEPS} SELECT piece_id, seg, i, d_pitch, d_time FROM st",
    "ngram_vectors": f"WITH {VECTORS} SELECT piece_id, seg, bucket, round(weight, 6) AS weight FROM v",
    "similarity_edges": f"WITH {EDGES} SELECT piece_id, a, b, round(sim, 4) AS sim FROM e",
    "top_neighbours": f"""WITH {RANKED} SELECT piece_id, count(*) AS n_edges FROM nb WHERE (sim >= 0.6 OR rank <= 5) AND iou < 0.25 AND same GROUP BY 1""",
    "segment_components": f"WITH RECURSIVE {COMPONENTS} SELECT piece_id, seg, component FROM comp",
    "segment_centrality": f"""WITH RECURSIVE {COMPONENTS}, t AS (SELECT s.piece_id, s.a, s.b, s.sim FROM sims s JOIN comp x ON x.piece_id = s.piece_id AND x.seg = s.a JOIN comp y ON y.piece_id = s.piece_id AND y.seg = s.b WHERE x.component = y.component),
w AS (SELECT piece_id, seg, sum(sim) AS total FROM (SELECT piece_id, a AS seg, sim FROM t UNION ALL SELECT piece_id, b, sim FROM t) GROUP BY 1, 2), n AS (SELECT piece_id, component, count(*) AS n FROM comp GROUP BY 1, 2)
SELECT c.piece_id, c.seg, round(coalesce(w.total, 0) / (n.n - 1), 4) AS score FROM comp c JOIN n USING (piece_id, component) LEFT JOIN w ON w.piece_id = c.piece_id AND w.seg = c.seg""",
    "retrieval_sweep": f"WITH {EDGES} SELECT piece_id, similarity, iou_bound AS iou, CAST(sum(CASE WHEN sim >= similarity AND iou < iou_bound THEN 1 ELSE 0 END) AS BIGINT) AS n_edges FROM (SELECT piece_id, sim, iou, unnest([0.7, 0.8, 0.9]::DOUBLE[]) AS similarity FROM sp) t, (SELECT unnest([0.25, 1.1]::DOUBLE[]) AS iou_bound) GROUP BY 1, 2, 3",
    "retrieval_subgraph": f"""WITH RECURSIVE {COMPONENTS}, n AS (SELECT piece_id, component, count(*) AS n FROM comp GROUP BY 1, 2), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY n DESC, component) AS k FROM n) WHERE k = 1),
core AS (SELECT comp.piece_id, seg FROM comp JOIN best USING (piece_id, component))
SELECT e.piece_id, (x.seg IS NOT NULL AND y.seg IS NOT NULL) AS "inner", count(*) AS n_edges FROM e LEFT JOIN core x ON x.piece_id = e.piece_id AND x.seg = e.a LEFT JOIN core y ON y.piece_id = e.piece_id AND y.seg = e.b WHERE x.seg IS NOT NULL OR y.seg IS NOT NULL GROUP BY 1, 2""",
}
