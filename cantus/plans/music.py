"""Queries of covers, cotexts, tokens and preparation over the notes view and the order tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import cotext, cover, prep, tokens
from ..operators.graph import in_parts
from ..session import ANNOTATED_SQL, annotated_notes, notes_view, table
from .geometry import MEASURES, PAIRS, SALIENT

#: New points that a class of a cover by gain must add: a third of the published 15, as pieces have some 60 points here.
LEAST_NEW = 5


def compress_cover(spark: SparkSession, d: str) -> DataFrame:
    return in_parts(notes_view(spark, d), cover.compress)


def compress_cover_strict(spark: SparkSession, d: str) -> DataFrame:
    return in_parts(notes_view(spark, d), lambda notes: cover.compress(notes, strict=True))


def compress_cover_conjugates(spark: SparkSession, d: str) -> DataFrame:
    """With conjugate classes among those to choose from."""
    return in_parts(notes_view(spark, d), lambda notes: cover.compress(notes, conjugates=True))


def cosiatec_cover(spark: SparkSession, d: str) -> DataFrame:
    """The class that each point is taken with, and in which round."""
    return in_parts(notes_view(spark, d), cover.cosiatec).select("piece_id", "onset", "pitch", "round", "d_onset", "d_pitch", "conjugate")


def forth_cover(spark: SparkSession, d: str) -> DataFrame:
    return in_parts(notes_view(spark, d), lambda notes: cover.forth(notes, least_new=LEAST_NEW))


def compact_parts(spark: SparkSession, d: str) -> DataFrame:
    return cover.trawl(notes_view(spark, d), 0.4, 2)


def cotext_motifs(spark: SparkSession, d: str) -> DataFrame:
    t = cotext.Tolerance(time=0, pitch=3, gap=2, min_notes=3, cardinality=0.5, horizon=12)
    return cotext.discover(annotated_notes(spark, d).select("piece_id", "onset", "pitch", "staff"), t)


def note_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Length of each note's context and whether its notes are all at different times."""
    t = cotext.Tolerance(min_notes=2)
    c = cotext.contexts(annotated_notes(spark, d).select("piece_id", "onset", "pitch", "staff"), t)
    times = F.transform("context", lambda x: x["bo"])
    return c.select("piece_id", F.col("i").cast("long").alias("i"), F.size("context").cast("long").alias("n"), (F.size(F.array_distinct(times)) == F.size("context")).alias("melodic"))


def anchor_pairs(spark: SparkSession, d: str) -> DataFrame:
    t = cotext.Tolerance(min_notes=3)
    c = cotext.contexts(annotated_notes(spark, d).select("piece_id", "onset", "pitch", "staff"), t)
    return cotext.anchor_pairs(c).groupBy("piece_id").agg(F.count(F.lit(1)).alias("n_pairs"))


def _downbeats(spark: SparkSession, d: str) -> DataFrame:
    ends = notes_view(spark, d).groupBy("piece_id").agg(F.min("onset").alias("a"), F.max("onset").alias("b"))
    return ends.select("piece_id", F.explode(F.sequence(F.col("a") + 3, F.greatest(F.col("b"), F.col("a") + 11), F.lit(8))).alias("downbeat"))


def bar_intervals(spark: SparkSession, d: str) -> DataFrame:
    return tokens.bars(_downbeats(spark, d)).select("piece_id", F.col("bar").cast("long").alias("bar"), "start", "end")


def _barred(spark: SparkSession, d: str) -> DataFrame:
    notes = annotated_notes(spark, d).select("piece_id", "onset", "pitch", (F.col("duration") * 137).alias("duration"))
    return tokens.in_bars(notes, tokens.bars(_downbeats(spark, d)))


def notes_in_bars(spark: SparkSession, d: str) -> DataFrame:
    return _barred(spark, d).select("piece_id", "onset", "pitch", F.col("bar").cast("long").alias("bar"))


def bar_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(tokens.events(_barred(spark, d))).select("piece_id", *(F.col(c).cast("long").alias(c) for c in ("w", "t_bar", "t_position", "t_pitch", "t_duration")))


def token_chunks(spark: SparkSession, d: str) -> DataFrame:
    return tokens.padding(tokens.chunks(tokens.events(_barred(spark, d)), 8, 32), 32)


def ensemble_predictions(spark: SparkSession, d: str) -> DataFrame:
    words = tokens.events(_barred(spark, d)).select("piece_id", "onset", "pitch", "w", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("run"))
    score = lambda k: ((F.col("onset") * 7 + F.col("pitch") * 3 + F.col("run") * 5 + k * 11) % 17) / 4 - 2
    scores = words.select("piece_id", "w", "run", F.floor((F.col("w") + 8 * F.col("run")) / 32).alias("chunk"), *(score(k).alias(f"s{k}") for k in range(4)))
    return tokens.ensemble(scores, 4).select("piece_id", F.col("w").cast("long").alias("w"), F.col("predicted").cast("long").alias("predicted"))


def fold_assignment(spark: SparkSession, d: str) -> DataFrame:
    return tokens.folds(notes_view(spark, d).select("piece_id").distinct(), F.col("piece_id")).select("piece_id", F.col("fold").cast("long").alias("fold"))


def pseudo_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = annotated_notes(spark, d)
    guess = F.col("pitch") % 3 == 0
    return rows.select("piece_id", "onset", "pitch", tokens.relabel(F.col("type"), guess, "predicted").alias("predicted"), tokens.relabel(F.col("type"), guess, "intersection").alias("intersection"))


def shifted_pitches(spark: SparkSession, d: str) -> DataFrame:
    rows = annotated_notes(spark, d).withColumn("type", F.when(F.col("type") == "view", "").otherwise(F.col("type"))).select("piece_id", "onset", F.col("pitch").alias("was"), "pitch", "type")
    return tokens.shifted(rows, 30).select("piece_id", "onset", "was", "pitch")


def labelled_means(spark: SparkSession, d: str) -> DataFrame:
    rows = annotated_notes(spark, d).withColumn("type", F.when(F.col("type") == "view", "").otherwise(F.col("type")))
    return tokens.class_means(rows).select("labelled", "n", F.round("mean_pitch", 6).alias("mean_pitch"))


def note_subset(spark: SparkSession, d: str) -> DataFrame:
    """Notes of two classes, with the name of their pitch."""
    rows = annotated_notes(spark, d).where(F.col("type").isin("click", "error"))
    return rows.select("piece_id", "onset", "pitch", "type", fn.pitch_name(F.col("pitch")).alias("name"))


def previous_order(spark: SparkSession, d: str) -> DataFrame:
    """Each order with the price of its customer's order before it: an as-of join, strictly earlier."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.col("o_totalprice").cast("double").alias("price"))
    prices = o.groupBy("o_custkey", F.col("o_orderdate").alias("at")).agg(F.max("price").alias("before"))
    return prep.as_of(o, prices, "o_custkey", "o_orderdate", "at", ["before"], strict=True).select("o_orderkey", F.round("before", 2).alias("before"))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return notes_view(spark, d).where("pitch % 4 = 0").groupBy("piece_id", (F.col("onset") * 480).alias("tick")).agg((60 + F.min("pitch")).alias("bpm"))


def tempo_map(spark: SparkSession, d: str) -> DataFrame:
    return prep.tempo_seconds(_changes(spark, d)).select("piece_id", "tick", "bpm", F.round("seconds", 5).alias("seconds"))


def note_seconds(spark: SparkSession, d: str) -> DataFrame:
    notes = notes_view(spark, d).select("piece_id", (F.col("onset") * 480 + F.col("pitch") * 7 % 480).alias("tick"), "pitch")
    return prep.note_seconds(notes, _changes(spark, d)).select("piece_id", "tick", "pitch", F.round("seconds", 4).alias("seconds"))


def note_beats(spark: SparkSession, d: str) -> DataFrame:
    """Notes' places between downbeats, drawn on at both ends."""
    w = Window.partitionBy("piece_id").orderBy("downbeat")
    beats = _downbeats(spark, d).select("piece_id", F.col("downbeat").alias("at"), F.row_number().over(w).alias("beat"))
    notes = notes_view(spark, d).select("piece_id", F.col("onset").alias("time"), "pitch")
    return prep.note_beats(notes, beats).select("piece_id", "time", "pitch", F.round("beat", 6).alias("beat"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    n = annotated_notes(spark, d)
    start = F.col("onset") * 240 + F.col("pitch") * 13 % 120
    return n.select("piece_id", start.alias("start"), (start + F.col("duration") * 700).alias("end"), "pitch")


def skyline_melody(spark: SparkSession, d: str) -> DataFrame:
    return prep.skyline(_spans(spark, d))


def piano_roll(spark: SparkSession, d: str) -> DataFrame:
    return prep.piano_roll(annotated_notes(spark, d)).groupBy("piece_id", "slot").agg(F.count(F.lit(1)).alias("n_sounding"))


def grid_notes(spark: SparkSession, d: str) -> DataFrame:
    a, b = prep.grid_ticks(F.col("start"), F.col("end"), 120)
    return _spans(spark, d).select("piece_id", F.col("start").alias("was"), "pitch", a.cast("long").alias("start"), b.cast("long").alias("end"))


def tempo_changes(spark: SparkSession, d: str) -> DataFrame:
    beats = _changes(spark, d).select("piece_id", (F.col("tick") / 480).cast("long").alias("beat"), (60 / F.col("bpm")).alias("length"))
    return prep.tempo_changes(beats)


def beats_without_voice(spark: SparkSession, d: str) -> DataFrame:
    n = annotated_notes(spark, d)
    return prep.without_collisions(n.where("staff = 0").select("piece_id", F.col("onset").alias("beat")).distinct(), n.where("staff = 1 and pitch < 70").select("piece_id", F.col("onset").alias("beat")))


def rounded_prices(spark: SparkSession, d: str) -> DataFrame:
    """Half-even and truncated hundredths, a bin and the nearest grid points of line items' prices and quantities."""
    q, x = F.col("l_quantity").cast("double"), F.col("l_discount").cast("double") * F.col("l_quantity").cast("double")
    return table(spark, d, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), fn.centibeat(F.round(x, 3)).alias("even"), fn.centibeat_floor(F.round(x, 4)).alias("cut"),
        fn.bin_of(q, (0, 5, 10, 20, 40, 50)).cast("long").alias("bin"), fn.nearest(q, 3, 12).cast("long").alias("near"), fn.scale_of(q, (8, 16, 32)).alias("scale"), fn.scale_of(q, (8, 16, 32), "closest").alias("closest"),
    )


def note_labels(spark: SparkSession, d: str) -> DataFrame:
    """Degrees and tempo classes spelled from customers' keys."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    text = F.concat(F.element_at(F.array(F.lit(""), F.lit("+"), F.lit("-")), (F.col("c_custkey") % 3 + 1).cast("int")), (F.col("c_nationkey") % 7 + 1).cast("string"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("/"), (F.col("c_custkey") % 7 + 1).cast("string"))).otherwise(""))
    a, b = fn.degree(F.col("degree"))
    kind, offset = fn.tempo_class((F.col("c_custkey") * 7 % 260).cast("int"))
    return c.withColumn("degree", text).select("c_custkey", "degree", a.cast("long").alias("first"), b.cast("long").alias("second"), kind.alias("tempo"), offset.cast("long").alias("tempo_offset"))


def oracle_notes(spark: SparkSession, d: str) -> DataFrame:
    """Distinct notes of all labelled occurrences: the union of two classes' notes, without a third's (set operations)."""
    n = annotated_notes(spark, d).select("piece_id", "onset", "pitch", "type")
    a, b, c = (n.where(F.col("type") == t).select("piece_id", "onset", "pitch") for t in ("click", "view", "error"))
    near = c.select("piece_id", "onset").distinct()
    return a.union(b).distinct().join(near, ["piece_id", "onset"], "left_anti")


QUERIES = {f.__name__: f for f in (compress_cover, compress_cover_strict, compress_cover_conjugates, cosiatec_cover, forth_cover, compact_parts, cotext_motifs, note_contexts, anchor_pairs, bar_intervals, notes_in_bars, bar_tokens, token_chunks, ensemble_predictions, fold_assignment, pseudo_labels, shifted_pitches, labelled_means, note_subset, previous_order, tempo_map, note_seconds, note_beats, skyline_melody, piano_roll, grid_notes, tempo_changes, beats_without_voice, rounded_prices, note_labels, oracle_notes)}

CONTEXT = ANNOTATED_SQL + """,
x AS (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY onset, pitch) - 1 AS i FROM anno),
c0 AS (SELECT a.piece_id, a.i, a.onset AS o, b.i AS j, b.onset AS bo, CASE WHEN lead(b.onset) OVER (PARTITION BY a.piece_id, a.i ORDER BY b.i) - b.onset > 2 THEN 1 ELSE 0 END AS gap FROM x a JOIN x b ON a.piece_id = b.piece_id AND a.staff = b.staff AND b.i > a.i AND b.onset < a.onset + 12),
c1 AS (SELECT *, max(gap) OVER (PARTITION BY piece_id, i ORDER BY j) AS cut FROM c0),
ctx AS (SELECT piece_id, i, any_value(o) AS o, count(*) AS n, count(DISTINCT bo) = count(*) AS melodic FROM c1 WHERE cut = 0 GROUP BY 1, 2)"""
BARS = ANNOTATED_SQL + """,
en AS (SELECT piece_id, min(onset) AS a, max(onset) AS b FROM anno GROUP BY 1),
db AS (SELECT piece_id, unnest(generate_series(a + 3, greatest(b, a + 11), 8)) AS t FROM en),
ex AS (SELECT piece_id, t FROM db UNION ALL SELECT piece_id, min(t) - 8 FROM db GROUP BY 1 UNION ALL SELECT piece_id, max(t) + 8 FROM db GROUP BY 1),
ba AS (SELECT piece_id, row_number() OVER w AS bar, t AS s, lead(t) OVER w AS e FROM ex WINDOW w AS (PARTITION BY piece_id ORDER BY t)),
bars AS (SELECT * FROM ba WHERE e IS NOT NULL),
nb AS (SELECT n.piece_id, n.onset, n.pitch, n.duration * 137 AS duration, bar, s, e FROM anno n JOIN bars b ON b.piece_id = n.piece_id AND n.onset >= s AND n.onset < e)"""
WORDS = BARS + """,
w AS (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY onset, pitch) - 1 AS w, row_number() OVER (PARTITION BY piece_id, bar ORDER BY onset, pitch) = 1 AS is_new FROM nb)"""
CHANGES = ANNOTATED_SQL + """,
ch AS (SELECT piece_id, onset * 480 AS tick, 60 + min(pitch) AS bpm FROM anno WHERE pitch % 4 = 0 GROUP BY 1, 2),
st AS (SELECT *, coalesce((tick - lag(tick) OVER w) / 480 * 60 / lag(bpm) OVER w, 0) AS step FROM ch WINDOW w AS (PARTITION BY piece_id ORDER BY tick)),
tm AS (SELECT piece_id, tick, bpm, sum(step) OVER (PARTITION BY piece_id ORDER BY tick ROWS UNBOUNDED PRECEDING) AS seconds FROM st)"""
SPANS = ANNOTATED_SQL + """,
sn AS (SELECT piece_id, onset * 240 + pitch * 13 % 120 AS s, onset * 240 + pitch * 13 % 120 + duration * 700 AS e, pitch FROM anno)"""



COVERS = MEASURES + """,
ix AS (SELECT *, CAST(row_number() OVER (PARTITION BY piece_id ORDER BY onset, pitch) - 1 AS INTEGER) AS k FROM notes),
cb AS (SELECT piece_id, d_onset, d_pitch, bitstring_agg(k, 0, 1023) AS bits FROM cover JOIN ix USING (piece_id, onset, pitch) GROUP BY 1, 2, 3),
none AS (SELECT piece_id, bitstring_agg(k, 0, 1023) & ~bitstring_agg(k, 0, 1023) AS bits FROM ix GROUP BY 1)"""


def _compress(less: int) -> str:
    return f"""WITH RECURSIVE {COVERS},
b AS (SELECT piece_id, d_onset, d_pitch, rank, size + n_translators - {less} AS need, bits FROM best JOIN cb USING (piece_id, d_onset, d_pitch) WHERE bit_count(bits) > size + n_translators - {less}),
r AS (SELECT piece_id, -1 AS step, 0::BIGINT AS rank, bits AS have, 0::BIGINT AS new FROM none
UNION ALL (SELECT r.piece_id, r.step + 1, b.rank, r.have | b.bits, bit_count(b.bits & ~r.have)::BIGINT FROM r JOIN b ON b.piece_id = r.piece_id AND b.rank > r.rank WHERE bit_count(b.bits & ~r.have) > b.need
  QUALIFY row_number() OVER (PARTITION BY r.piece_id ORDER BY b.rank) = 1))
SELECT piece_id, d_onset, d_pitch, false AS conjugate, step, new::INTEGER AS new_points FROM r JOIN b USING (piece_id, rank)"""


def _forth(least: int, overlap: float) -> str:
    return f"""WITH RECURSIVE {COVERS}, {SALIENT},
b AS (SELECT piece_id, d_onset, d_pitch, salience, bits FROM sal JOIN cb USING (piece_id, d_onset, d_pitch) WHERE salience > 0),
r AS (SELECT piece_id, -1 AS step, 0::BIGINT AS d_onset, 0::BIGINT AS d_pitch, bits AS have, 0::BIGINT AS new, bits AS own, []::BIT[] AS prim, []::INTEGER[] AS steps, -1 AS primary_step FROM none
UNION ALL (SELECT piece_id, step + 1, d_onset, d_pitch, have | bits, new, bits, CASE WHEN near IS NULL THEN list_append(prim, bits) ELSE prim END, CASE WHEN near IS NULL THEN list_append(steps, step + 1) ELSE steps END, coalesce(near, step + 1)
  FROM (SELECT r.piece_id, r.step, b.d_onset, b.d_pitch, r.have, b.bits, bit_count(b.bits & ~r.have)::BIGINT AS new, r.prim, r.steps,
      list_filter(list_zip(r.prim, r.steps), lambda p: bit_count(p[1] & b.bits) / bit_count(p[1]) > {overlap})[1][2] AS near
    FROM r JOIN b ON b.piece_id = r.piece_id WHERE bit_count(b.bits & ~r.have) >= {least}
    QUALIFY row_number() OVER (PARTITION BY r.piece_id ORDER BY bit_count(b.bits & ~r.have) * b.salience DESC, b.d_onset, b.d_pitch) = 1)))
SELECT piece_id, d_onset, d_pitch, step, new::INTEGER AS new_points, primary_step, primary_step <> step AS secondary FROM r WHERE step >= 0"""


ORACLE = {
    "compress_cover": _compress(1),
    "compress_cover_strict": _compress(0),
    "forth_cover": _forth(LEAST_NEW, 0.5),
    "compact_parts": f"""WITH RECURSIVE {PAIRS}, i AS (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY onset, pitch) - 1 AS idx FROM notes),
p AS (SELECT piece_id, d_onset, d_pitch, idx, row_number() OVER (PARTITION BY piece_id, d_onset, d_pitch ORDER BY idx) AS k, count(*) OVER (PARTITION BY piece_id, d_onset, d_pitch) AS size FROM pairs JOIN i USING (piece_id, onset, pitch)),
r AS (SELECT piece_id, d_onset, d_pitch, k, size, idx AS first, 1 AS n, 0 AS part, 0 AS cut FROM p WHERE k = 1
UNION ALL SELECT p.piece_id, p.d_onset, p.d_pitch, p.k, p.size, CASE WHEN (n + 1) / (idx - first + 1) >= 0.4 THEN first ELSE idx END, CASE WHEN (n + 1) / (idx - first + 1) >= 0.4 THEN n + 1 ELSE 1 END, CASE WHEN (n + 1) / (idx - first + 1) >= 0.4 THEN part ELSE part + 1 END, CASE WHEN (n + 1) / (idx - first + 1) >= 0.4 THEN 0 ELSE n END
  FROM r JOIN p ON p.piece_id = r.piece_id AND p.d_onset = r.d_onset AND p.d_pitch = r.d_pitch AND p.k = r.k + 1)
SELECT piece_id, d_onset, d_pitch, part - 1 AS part, cut AS size FROM r WHERE cut >= 2 UNION ALL SELECT piece_id, d_onset, d_pitch, 0, n FROM r WHERE k = size AND part = 0 AND n >= 2""",
    "tempo_changes": f"""WITH RECURSIVE {CHANGES}, o AS (SELECT piece_id, tick // 480 AS beat, 60 / bpm AS length, row_number() OVER (PARTITION BY piece_id ORDER BY tick // 480, 60 / bpm) AS k FROM tm),
r AS (SELECT piece_id, k, beat, length, length AS last, true AS kept FROM o WHERE k = 1 UNION ALL SELECT o.piece_id, o.k, o.beat, o.length, CASE WHEN abs(r.last - o.length) > 0.05 THEN o.length ELSE r.last END, abs(r.last - o.length) > 0.05 FROM r JOIN o ON o.piece_id = r.piece_id AND o.k = r.k + 1)
SELECT piece_id, beat::BIGINT AS beat, length FROM r WHERE kept""",
    "note_contexts": f"WITH {CONTEXT} SELECT piece_id, i, n, melodic FROM ctx",
    "anchor_pairs": f"WITH {CONTEXT} SELECT a.piece_id, count(*) AS n_pairs FROM ctx a JOIN ctx b ON a.piece_id = b.piece_id AND a.i < b.i AND b.o - a.o >= 2 WHERE a.n >= 2 AND b.n >= 2 GROUP BY 1",
    "bar_intervals": f"WITH {BARS} SELECT piece_id, bar, s AS start, e AS \"end\" FROM bars",
    "notes_in_bars": f"WITH {BARS} SELECT piece_id, onset, pitch, bar FROM nb",
    "bar_tokens": f"WITH {WORDS} SELECT piece_id, w, CASE WHEN is_new THEN 0 ELSE 1 END::BIGINT AS t_bar, greatest(0, least(15, ceil((onset - s) / (e - s) * 16 - 0.5)))::BIGINT AS t_position, greatest(0, least(85, pitch - 22))::BIGINT AS t_pitch, greatest(0, least(63, ceil((duration - 60) / 60 - 0.5)))::BIGINT AS t_duration FROM w",
    "token_chunks": f"WITH {WORDS} SELECT piece_id, CAST(floor((w + 8) / 32) AS BIGINT) AS chunk, count(*) AS n_words, 32 - count(*) AS n_padding FROM w GROUP BY 1, 2",
    "ensemble_predictions": f"""WITH {WORDS}, r AS (SELECT piece_id, w, onset, pitch, unnest([0, 1, 2]) AS run FROM w),
s AS (SELECT piece_id, w, run, CAST(floor((w + 8 * run) / 32) AS BIGINT) AS chunk, {', '.join(f'((onset * 7 + pitch * 3 + run * 5 + {k * 11}) % 17) / 4 - 2 AS s{k}' for k in range(4))} FROM r),
l AS (SELECT *, least(max(greatest(s1, s2) - greatest(s0, s3)) OVER (PARTITION BY piece_id, run, chunk), 0) AS lift FROM s),
t AS (SELECT piece_id, w, round(sum(s0), 6) AS a, round(sum(s1 - lift), 6) AS b, round(sum(s2 - lift), 6) AS c, round(sum(s3), 6) AS d FROM l GROUP BY 1, 2)
SELECT piece_id, w, CASE greatest(a, b, c, d) WHEN a THEN 0 WHEN b THEN 1 WHEN c THEN 2 ELSE 3 END::BIGINT AS predicted FROM t""",
    "fold_assignment": f"WITH {ANNOTATED_SQL}, p AS (SELECT DISTINCT piece_id, piece_id % 32 AS k FROM anno) SELECT piece_id, CASE WHEN k < 7 THEN 0 WHEN k < 14 THEN 1 WHEN k < 20 THEN 2 WHEN k < 26 THEN 3 ELSE 4 END::BIGINT AS fold FROM p",
    "pseudo_labels": f"WITH {ANNOTATED_SQL} SELECT piece_id, onset, pitch, CASE WHEN pitch % 3 = 0 THEN 'a' ELSE '' END AS predicted, CASE WHEN pitch % 3 = 0 THEN type ELSE '' END AS intersection FROM anno",
    "shifted_pitches": f"WITH {ANNOTATED_SQL} SELECT piece_id, onset, pitch AS was, CASE WHEN type = 'view' THEN greatest(24, least(107, pitch + 30)) ELSE pitch END AS pitch FROM anno",
    "labelled_means": f"WITH {ANNOTATED_SQL} SELECT type <> 'view' AS labelled, count(*) AS n, round(avg(pitch), 6) AS mean_pitch FROM anno GROUP BY 1",
    "note_subset": f"WITH {ANNOTATED_SQL} SELECT piece_id, onset, pitch, type, (['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'])[pitch % 12 + 1] AS name FROM anno WHERE type IN ('click', 'error')",
    "previous_order": "WITH p AS (SELECT o_custkey, o_orderdate AS d, max(CAST(o_totalprice AS DOUBLE)) AS price FROM orders GROUP BY 1, 2) SELECT o.o_orderkey, round(p.price, 2) AS before FROM orders o ASOF LEFT JOIN p ON o.o_custkey = p.o_custkey AND o.o_orderdate > p.d",
    "tempo_map": f"WITH {CHANGES} SELECT piece_id, tick, bpm, round(seconds, 5) AS seconds FROM tm",
    "note_seconds": f"""WITH {CHANGES}, n AS (SELECT piece_id, onset * 480 + pitch * 7 % 480 AS tick, pitch FROM anno)
SELECT n.piece_id, n.tick, n.pitch, round(coalesce(tm.seconds, 0) + (n.tick - coalesce(tm.tick, 0)) / 480 * 60 / coalesce(tm.bpm, 120), 4) AS seconds FROM n ASOF LEFT JOIN tm ON n.piece_id = tm.piece_id AND n.tick > tm.tick""",
    "note_beats": f"""WITH {BARS}, k AS (SELECT piece_id, t, row_number() OVER w AS beat, coalesce(lead(t) OVER w - t, t - lag(t) OVER w) AS len FROM db WINDOW w AS (PARTITION BY piece_id ORDER BY t)), f AS (SELECT * FROM k WHERE beat = 1)
SELECT n.piece_id, n.onset AS time, n.pitch, round(coalesce(k.beat, f.beat) + (n.onset - coalesce(k.t, f.t)) / coalesce(k.len, f.len), 6) AS beat FROM anno n ASOF LEFT JOIN k ON n.piece_id = k.piece_id AND n.onset >= k.t JOIN f ON f.piece_id = n.piece_id""",
    "skyline_melody": f"""WITH {SPANS}, q AS (SELECT piece_id, CAST(round_even(s / 240, 0) AS BIGINT) * 240 AS s, CAST(round_even((CASE WHEN e - s > 1920 THEN s + 960 ELSE e END) / 240, 0) AS BIGINT) * 240 AS e, pitch FROM sn WHERE pitch >= 60),
t AS (SELECT *, lead(s) OVER (PARTITION BY piece_id ORDER BY s) AS nx FROM (SELECT *, row_number() OVER (PARTITION BY piece_id, s ORDER BY pitch DESC, e) AS k FROM q) WHERE k = 1),
u AS (SELECT piece_id, s, e, pitch, lead(s) OVER (PARTITION BY piece_id ORDER BY s) AS nx FROM t WHERE nx IS NOT NULL),
v AS (SELECT piece_id, s, CASE WHEN e >= nx THEN nx ELSE e END AS e, pitch FROM u), z AS (SELECT *, lag(pitch) OVER w AS p0, lead(pitch) OVER w AS p1 FROM v WHERE s <> e WINDOW w AS (PARTITION BY piece_id ORDER BY s))
SELECT piece_id, s AS start, e AS "end", pitch FROM z WHERE NOT coalesce(pitch - p0 <= -9 AND pitch - p1 <= -9, false)""",
    "piano_roll": f"WITH {ANNOTATED_SQL}, r AS (SELECT DISTINCT piece_id, unnest(generate_series(onset, onset + duration - 1)) AS slot, pitch FROM anno) SELECT piece_id, slot, count(*) AS n_sounding FROM r GROUP BY 1, 2",
    "grid_notes": f"WITH {SPANS} SELECT piece_id, s AS was, pitch, CAST(ceil(s / 120 - 0.5) * 120 AS BIGINT) AS start, CAST(e + ceil(s / 120 - 0.5) * 120 - s AS BIGINT) AS \"end\" FROM sn",
    "beats_without_voice": f"WITH {ANNOTATED_SQL} SELECT DISTINCT piece_id, onset AS beat FROM anno a WHERE staff = 0 AND NOT EXISTS (SELECT 1 FROM anno b WHERE b.piece_id = a.piece_id AND b.staff = 1 AND b.pitch < 70 AND b.onset BETWEEN a.onset - 1 AND a.onset + 2)",
    "rounded_prices": "WITH l AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_quantity AS DOUBLE) AS q, CAST(l_discount AS DOUBLE) * CAST(l_quantity AS DOUBLE) AS x FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(round_even(round(x, 3) * 100, 0) AS BIGINT) AS even, CAST(trunc(round(x, 4) * 100) AS BIGINT) AS cut, (CAST(q >= 5 AS BIGINT) + CAST(q >= 10 AS BIGINT) + CAST(q >= 20 AS BIGINT) + CAST(q >= 40 AS BIGINT)) AS bin, CAST(greatest(0, least(11, ceil((q - 3) / 3 - 0.5))) AS BIGINT) AS near, CASE WHEN q <= 8 THEN '8' WHEN q <= 16 THEN '16' WHEN q <= 32 THEN '32' ELSE '>32' END AS scale, CASE WHEN q <= 12 THEN '8' WHEN q <= 24 THEN '16' ELSE '32' END AS closest FROM l",
    "note_labels": """WITH c AS (SELECT c_custkey, (['', '+', '-'])[c_custkey % 3 + 1] || (c_nationkey % 7 + 1) || CASE WHEN c_custkey % 2 = 0 THEN '/' || (c_custkey % 7 + 1) ELSE '' END AS degree, c_nationkey % 7 + CASE c_custkey % 3 WHEN 1 THEN 7 WHEN 2 THEN 14 ELSE 0 END AS a, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 7 ELSE 0 END AS b, c_custkey * 7 % 260 AS t FROM customer)
SELECT c_custkey, degree, CAST(a AS BIGINT) AS first, CAST(b AS BIGINT) AS second, CASE WHEN t < 90 THEN 'slow' WHEN t < 150 THEN 'mid' ELSE 'fast' END AS tempo, CAST(greatest(0, least(59, t - CASE WHEN t < 90 THEN 30 WHEN t < 150 THEN 90 ELSE 150 END)) AS BIGINT) AS tempo_offset FROM c""",
    "oracle_notes": f"WITH {ANNOTATED_SQL} SELECT DISTINCT piece_id, onset, pitch FROM anno a WHERE type IN ('click', 'view') AND NOT EXISTS (SELECT 1 FROM anno b WHERE b.type = 'error' AND b.piece_id = a.piece_id AND b.onset = a.onset)",
}
