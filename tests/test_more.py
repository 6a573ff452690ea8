"""Student's tails, maps, MIDI writing and tempi, scorers, presets, readers."""

import random

import pytest
from pyspark.sql import functions as F

from cantus.functions import scalar
from cantus.operators import discover, evaluate, scorer, tokens
from cantus.sources import midi
from cantus.sources.notes import read_json, read_points, write_json


def test_tails_and_intervals_of_students_distribution(spark):
    """Published quantiles."""
    rows = [(12.7062, 1.0, 0.025), (4.30265, 2.0, 0.025), (2.22814, 10.0, 0.025), (1.64485, 1e6, 0.05), (0.0, 5.0, 0.5), (-2.22814, 10.0, 0.975)]
    got = spark.createDataFrame(rows, "t double, f double, p double").select(scalar.t_tail(F.col("t"), F.col("f")).alias("got"), "p").collect()
    assert all(r.got == pytest.approx(r.p, abs=1e-5) for r in got)
    v = spark.createDataFrame([(x,) for x in (0.831, 0.8313, 0.8351)], "v double")
    m = evaluate.mean_interval(v, F.col("v")).first()
    se = 0.00229 / 3**0.5
    assert m.mean == pytest.approx(0.83247, abs=1e-4) and m.high - m.mean == pytest.approx(4.30265 * se, rel=0.02) and m.mean - m.low == pytest.approx(m.high - m.mean)


def test_key_and_chord_maps(spark):
    keys = {"C": 0, "C-": 11, "E+": 5, "B+": 0, "c": 0, "f+": 6, "b-": 22, "e+": 17, "c-": 23, "H": None, "C++": None, "": None}
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", scalar.tonic_number(F.col("k")).alias("n")).collect()
    assert {r.k: r.n for r in got} == keys
    got = spark.createDataFrame([("M",), ("a6",), ("x",), (None,)], "q string").select(scalar.quality_number(F.col("q")).alias("n")).collect()
    assert [r.n for r in got] == [0, 9, None, None]


def test_midi_files_written_and_read(spark, tmp_path):
    r = random.Random(0)
    notes = [("p", float(k), r.choice([0.5, 1.0, 2.5]), 40 + k) for k in range(30)]
    out = midi.to_midi(spark.createDataFrame(notes, "piece_id string, onset double, duration double, pitch int"), bpm=90).collect()
    (tmp_path / "p.mid").write_bytes(bytes(out[0].content))
    got = sorted((n.onset, n.end - n.onset, n.pitch) for n in midi.melody_tracks(midi.read_midi(spark, str(tmp_path))).collect())
    assert got == [(a, b, c) for _, a, b, c in notes]
    tempi = midi.read_tempi(spark, str(tmp_path))
    assert [(t.tick, round(t.bpm, 3)) for t in tempi.collect()] == [(0, 90.0)]
    beats = midi.tempo_beats(tempi, spark.createDataFrame([("p", 3.2)], "piece_id string, beat double")).orderBy("beat").collect()
    assert [b.at for b in beats] == pytest.approx([0, 2 / 3, 4 / 3, 2, 8 / 3], abs=1e-5)
    assert midi.file_tempi(b"no midi") == []


def test_scorers_plug_in(spark):
    words = spark.createDataFrame([(0, k, int(k % 4 > 0), k % 16, k % 80, 3) for k in range(40)], "piece_id long, w long, t_bar int, t_position int, t_pitch int, t_duration int")

    class Highest:
        classes = 4

        def score(self, fields):
            out = fields[:, [2, 2, 2, 2]] * 0.0
            out[:, 1] = fields[:, 2] - 30
            return out

    got = scorer.melody(words, [Highest()], length=64).collect()
    assert sorted(r.w for r in got) == list(range(31, 40))
    lifted = scorer.scored(words, Highest(), 2, 8, 16)
    assert lifted.where("run = 2").select("chunk").distinct().count() == 3 and lifted.where("s1 <> w - 30").count() == 0


def test_labels_and_variants(spark):
    words = spark.createDataFrame([(0, k, "a" if k % 3 else "") for k in range(20)], "piece_id long, w long, type string")
    got = {(r.chunk, r.pos): r.label for r in tokens.aligned_labels(tokens.chunks(words, 4, 16), 16).collect()}
    assert len(got) == 32 and all(got[(k + 4) // 16, (k + 4) % 16] == (1 if k % 3 else 3) for k in range(20)) and sum(v == 0 for v in got.values()) == 12
    notes = spark.createDataFrame([(p, 0, 60, t) for p in range(8) for t in ("", "a")], "piece_id long, onset long, pitch int, type string")
    drawn = tokens.variants(notes, keep=3)
    assert drawn.groupBy("piece_id").agg(F.count_distinct("variant").alias("n")).where("n <> 3").count() == 0 and drawn.select("variant").distinct().count() > 5
    assert drawn.where("type = 'a' and pitch <> 60 or type = '' and pitch <> 60 + semitones").count() == 0


def test_presets(spark):
    bar = [(0, 60), (1, 64), (2, 67), (3, 65)]
    notes = spark.createDataFrame([(p, 16 * k + a, b) for p in (0, 1) for k in range(4) for a, b in bar], "piece_id long, onset long, pitch long")
    found = discover.discover(notes, "SIATEC", [1])
    assert {r.piece_id for r in found.collect()} == {1} and found.groupBy("motif", "occurrence").count().agg(F.max("count")).first()[0] >= 4
    filled = discover.discover(notes, "SIATEC_CS").groupBy("piece_id").agg(F.count_distinct("onset", "pitch").alias("n")).collect()
    assert {r.n for r in filled} == {16}
    with pytest.raises(ValueError):
        discover.discover(notes, "none")


def test_points_of_three_dimensions_and_json(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("x,y,z\n1,2,3\n4,5,6.5\n7,8\n")
    assert sorted(tuple(r) for r in read_points(spark, str(tmp_path / "in"), 3).collect()) == [("a", 1, 2, 3), ("a", 4, 5, 6.5)]
    assert sorted(tuple(r) for r in read_points(spark, str(tmp_path / "in")).collect()) == [("a", 1, 2), ("a", 4, 5), ("a", 7, 8)]
    rows = spark.createDataFrame([(1, 0, [1.0, 2.0]), (2, 0, [])], "piece_id long, seg long, v array<double>")
    write_json(rows, str(tmp_path / "out"))
    back = read_json(spark, str(tmp_path / "out"), "piece_id long, seg long, v array<double>").select(rows.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
