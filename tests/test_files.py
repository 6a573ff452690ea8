"""Workbooks and NumPy files, written here and read back."""

import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cantus.operators import prep
from cantus.sources import arrays, workbooks


def book(path, sheets, shared=()):
    """A workbook of rows of XML cells; sheets are listed in the workbook's order, the files the other way round."""
    main, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w") as z:
        n = len(sheets)
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="s{k}" sheetId="{k + 1}" r:id="rId{k}"/>' for k in range(n)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{k}" Target="{"/xl/" if k else ""}worksheets/sheet{n - k}.xml"/>' for k in range(n)) + "</Relationships>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")
        for k, rows in enumerate(sheets):
            z.writestr(f"xl/worksheets/sheet{n - k}.xml", f"<worksheet {main}><sheetData>" + "".join(f"<row>{r}</row>" for r in rows) + "</sheetData></worksheet>")


def n(name, v):
    return f'<c r="{name}"><v>{v}</v></c>'


def s(name, k):
    return f'<c r="{name}" t="s"><v>{k}</v></c>'


def test_cells_of_every_kind(spark, tmp_path):
    shared = ["<t>plain</t>", "<r><t>of </t></r><r><t>runs</t></r><rPh><t>x</t></rPh>", "<t/>"]
    rows = [s("A1", 0) + s("C1", 1) + '<c r="D1" t="inlineStr"><is><t>in</t></is></c>', n("B2", "1.50") + '<c r="AA2" t="b"><v>1</v></c>', '<c r="A3" t="e"><v>#N/A</v></c><c r="B3" t="str"><f>A1</f><v>f</v></c>' + n("C3", "-7") + n("D3", "1E2") + "<c r=\"E3\"/>"]
    book(tmp_path / "a.xlsx", [rows, [n("A1", 9)]], shared)
    got = {r.row: [c and (c.text, c.number) for c in r.cells] for r in workbooks.read_cells(spark, str(tmp_path)).collect()}
    assert got[1] == [("plain", None), None, ("of runs", None), ("in", None)]
    assert got[2][1] == ("1.5", 1.5) and got[2][26] == ("True", 1.0) and len(got[2]) == 27
    assert got[3] == [None, ("f", None), ("-7", -7.0), ("100.0", 100.0), None]
    assert [len(r.cells) for r in workbooks.read_cells(spark, str(tmp_path), columns=2).collect()] == [1, 2, 2]
    assert workbooks.read_cells(spark, str(tmp_path), sheet=1).first().cells[0].number == 9.0
    assert workbooks.read_cells(spark, str(tmp_path), sheet=2).collect() == []


def test_downbeats_join_notes(spark, tmp_path):
    book(tmp_path / "p1.xlsx", [["<c r=\"A1\" t=\"inlineStr\"><is><t>downbeat</t></is></c>", n("A2", 0), n("A3", 4), '<c r="A4" t="inlineStr"><is><t> 8.5 </t></is></c>', n("B5", 3)]])
    downbeats = workbooks.read_workbook_downbeats(spark, str(tmp_path))
    assert sorted(map(tuple, downbeats.collect())) == [("p1", 0.0), ("p1", 4.0), ("p1", 8.5)]
    from cantus.operators import tokens

    notes = spark.createDataFrame([("p1", 1.0, 60), ("p1", 4.0, 61), ("p1", 9.0, 62)], "piece_id string, onset double, pitch int")
    assert [(r.onset, r.start) for r in tokens.in_bars(notes, tokens.bars(downbeats)).orderBy("onset").collect()] == [(1.0, 0.0), (4.0, 4.0), (9.0, 8.5)]


def test_chords(spark, tmp_path):
    shared = [f"<t>{t}</t>" for t in ("onset", "C", "M", "V/ii", "x")]
    header = "".join(s(f"{c}1", 0) for c in "ABCDEFG")
    rows = [header, n("A2", 0) + n("B2", "1.5") + s("C2", 1) + n("D2", "5.0") + s("E2", 2) + n("F2", 1) + s("G2", 3), n("A3", "-1") + n("B3", 2) + n("D3", "4.5") + n("G3", 7), s("B4", 4)]
    book(tmp_path / "1/chords.xlsx", [rows], shared)
    book(tmp_path / "2/chords.xlsx", [[n("A1", 0) + n("B1", 1)]])
    got = workbooks.read_workbook_chords(spark, str(tmp_path)).orderBy("row").collect()
    assert [tuple(r) for r in got] == [("1", 2, 0.0, 1.5, "C", "5", "M", 1, "V/ii"), ("1", 3, -1.0, 2.0, "", "4.5", "", 0, "7")]
    chords = workbooks.read_workbook_chords(spark, str(tmp_path))
    notes = spark.createDataFrame([("1", -2.0), ("1", 0.0), ("1", 9.0)], "piece_id string, at double")
    assert [r.degree for r in prep.as_of(notes, chords, "piece_id", "at", "onset", ["degree"]).orderBy("at").collect()] == [None, "5", "5"]


def test_arrays_are_split_by_rows(spark, tmp_path):
    big = np.arange(1_000_000 * 4, dtype="<f4").reshape(-1, 4)
    np.save(tmp_path / "big.npy", big)
    df = arrays.read_numpy(spark, str(tmp_path / "big.npy"), split=1 << 20)
    assert df.dtypes == [("row", "bigint"), ("value", "array<float>")] and df.rdd.getNumPartitions() == 16
    got = df.agg(F.count("*"), F.sum(F.col("value")[3].cast("double")), F.max("row")).first()
    assert tuple(got) == (1_000_000, float(big[:, 3].astype(float).sum()), 999_999)
    arrays.write_numpy(df.select("value"), str(tmp_path / "out"))
    parts = sorted(os.listdir(tmp_path / "out"))
    assert len(parts) == 16 and all(p.endswith(".npy") for p in parts)
    assert np.array_equal(np.concatenate([np.load(tmp_path / "out" / p) for p in parts]), big)
    assert arrays.read_numpy(spark, str(tmp_path / "out")).where("value[0] <> row * 4").count() == 0


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_archives(spark, tmp_path, save):
    r = np.random.default_rng(0)
    tokens, tempo, names, half = r.integers(0, 99, (3000, 5, 4)), r.random(3000), np.array([f"ä{k}" for k in range(3000)]), r.random(3000).astype(">f2")
    save(tmp_path / "a.npz", tokens=tokens, tempo=tempo, names=names, half=half, small=r.integers(0, 250, 3000).astype(np.uint8))
    df = arrays.read_numpy(spark, str(tmp_path), split=100_000)
    assert dict(df.dtypes) == {"row": "bigint", "tokens": "array<array<bigint>>", "tempo": "double", "names": "string", "half": "float", "small": "smallint"}
    assert (df.rdd.getNumPartitions() > 4) == (save is np.savez)
    got = df.orderBy("row").toPandas()
    assert np.array_equal(np.array([[list(x) for x in t] for t in got.tokens]), tokens) and got.tempo.tolist() == tempo.tolist() and got.names.tolist() == names.tolist()
    assert np.allclose(got.half, half.astype(float))
    assert arrays.read_numpy(spark, str(tmp_path), columns=["tempo"]).columns == ["row", "tempo"]
    arrays.write_numpy(df.select("row", "tempo", "tokens"), str(tmp_path / "out"), kind="npz")
    again = arrays.read_numpy(spark, str(tmp_path / "out")).select("tempo", "tokens")
    assert again.exceptAll(df.select("tempo", "tokens")).count() == 0 and again.count() == 3000


def test_odd_arrays(spark, tmp_path):
    a = np.asfortranarray(np.arange(12.0).reshape(4, 3))
    np.save(tmp_path / "f.npy", a)
    assert [r.value for r in arrays.read_numpy(spark, str(tmp_path / "f.npy"), split=24).orderBy("row").collect()] == a.tolist()
    np.save(tmp_path / "e.npy", np.zeros((0, 3)))
    assert arrays.read_numpy(spark, str(tmp_path / "e.npy")).collect() == []
    np.save(tmp_path / "o.npy", np.array([{}]), allow_pickle=True)
    with pytest.raises(Exception, match="can't be read"):
        arrays.read_numpy(spark, str(tmp_path / "o.npy")).collect()


def test_an_aborted_write_leaves_nothing_and_an_append_adds(spark, tmp_path):
    good = spark.range(10).select(F.col("id").alias("x"))
    bad = spark.range(10).repartition(4).select(F.when(F.col("id") < 9, F.array("id")).otherwise(F.array("id", "id")).alias("x"))
    with pytest.raises(Exception):
        arrays.write_numpy(bad, str(tmp_path / "w"))
    assert not (tmp_path / "w").exists()
    arrays.write_numpy(good, str(tmp_path / "w"))
    with pytest.raises(Exception):
        arrays.write_numpy(bad, str(tmp_path / "w"), mode="append")
    assert arrays.read_numpy(spark, str(tmp_path / "w")).count() == 10 and not any(f.startswith("_") for f in os.listdir(tmp_path / "w"))
    arrays.write_numpy(good, str(tmp_path / "w"), mode="append")
    assert arrays.read_numpy(spark, str(tmp_path / "w")).count() == 20
    with pytest.raises(Exception, match="one array"):
        arrays.write_numpy(good.withColumn("y", F.lit(1)), str(tmp_path / "w"))


def test_annotated_notes_have_sixteen_columns(spark, tmp_path):
    from cantus.sources import notes

    rows = spark.createDataFrame([("p1", 0.5, 60, 1.0, 0, 1, "C", "a"), ("p1", 1.0, 62, 0.5, 1, 1, None, "")], "piece_id string, onset double, pitch int, duration double, staff int, measure int, key string, type string")
    notes.write_annotated(rows.coalesce(1), str(tmp_path / "n"))
    (file,) = (tmp_path / "n/piece_id=p1").glob("*.csv")
    lines = file.read_text().splitlines()
    assert lines[0] == "onset,midi_note_number,morphetic_pitch_number,duration,staff_number,measure,localbeat,key,degree,quality,inversion,roman numeral notation,motif_type,boundary,hnote,lnote"
    assert sorted(lines[1:]) == ["0.5,60,,1.0,0,1,,C,,,,,a,,,", "1.0,62,,0.5,1,1,,,,,,,,,,"]


def test_windows_of_beats(spark):
    from cantus.operators import retrieval

    beats = spark.createDataFrame([("p", k, 0.5 * k) for k in range(4)] + [("p", k, 1.5 + (k - 3)) for k in range(4, 30)], "piece_id string, beat int, at double")
    notes = spark.createDataFrame([("p", x, 60) for x in (0.0, 0.5, 1.0, 1.5, 2.5, 3.5, 10.0)], "piece_id string, onset double, pitch int")
    cfg = retrieval.Config(scales=(4,), hop=0.5, min_notes=3)
    got = {}
    for r in retrieval.beat_windows(notes, beats, cfg).collect():
        got.setdefault((r.start, r.end), []).append(r.onset)
    assert {k: sorted(v) for k, v in got.items()} == {(0.0, 4.0): [0.0, 0.5, 1.0, 1.5], (2.0, 6.0): [1.0, 1.5, 2.5, 3.5]}


def test_encoder_with_weights_of_a_file(spark, tmp_path):
    """Vectors of a file's weights against attention written out step by step."""
    from cantus.operators import encoder

    w = encoder.random_weights(width=8, heads=2, layers=1, seed=3)
    r = np.random.default_rng(1)
    w = {k: (v if k in ("heads", "layers") else v + 0.1 * r.normal(size=v.shape)) for k, v in w.items()}
    np.savez(tmp_path / "w.npz", **w)
    steps = [("a", 0, i, int(r.integers(-5, 6)), float(r.normal())) for i in range(5)] + [("b", 1, i, int(r.integers(-5, 6)), float(r.normal())) for i in range(2)]
    got = {(x.piece_id, x.seg): x.vector for x in encoder.segment_vectors(spark.createDataFrame(steps, "piece_id string, seg int, i int, d_pitch int, d_time double"), encoder.read_weights(str(tmp_path / "w.npz"))).collect()}

    def norm(x, a, b):
        return (x - sum(x) / 8) / (sum((x - sum(x) / 8) ** 2) / 8 + 1e-5) ** 0.5 * a + b

    for piece, seg in (("a", 0), ("b", 1)):
        x = [np.array(s[3:]) for s in steps if s[0] == piece]
        h = [v @ w["in.w"] + w["in.b"] + np.array([f(t / 10000 ** (2 * (k // 2) / 8)) for k in range(8) for f in [(np.sin, np.cos)[k % 2]]]) for t, v in enumerate(x)]
        line = lambda v, n: v @ w[f"0.{n}.w"] + w[f"0.{n}.b"]
        out = []
        for t, v in enumerate(h):
            heads = []
            for a in (slice(0, 4), slice(4, 8)):
                e = np.exp([line(v, "q")[a] @ line(u, "k")[a] / 2 for u in h])
                heads.append(sum(p * line(u, "v")[a] for p, u in zip(e / e.sum(), h)))
            y = norm(v + line(np.concatenate(heads), "o"), w["0.n1.w"], w["0.n1.b"])
            out.append(norm(y + line(np.maximum(line(y, "f1"), 0), "f2"), w["0.n2.w"], w["0.n2.b"]))
        z = sum(out) / len(out) @ w["out.w"] + w["out.b"]
        assert np.allclose(got[piece, seg], z / np.linalg.norm(z), atol=1e-5)
