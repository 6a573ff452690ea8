"""Streamed difference vectors against the batch, in batches of any kind."""

import datetime as dt
import random
from collections import Counter

import pytest

from cantus.operators import geometry
from cantus.streaming import mtp

HOUR = 3_600_000
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def moment(onset):
    return START + dt.timedelta(hours=onset)


def batches(seed, sizes, in_order):
    r = random.Random(seed)
    notes = list({(p, r.randrange(60), r.randrange(60, 66)) for p in (1, 2, 3) for _ in range(40)})
    r.shuffle(notes)
    if in_order:
        notes.sort(key=lambda n: n[1])
    out, i = [], 0
    for n in sizes:
        out.append(notes[i : i + n] + notes[max(0, i - 2) : i])  # the last two come again
        i += n
    return [*out, notes[i:]]


def run(spark, tmp_path, parts, between=lambda q: None, **options):
    """Writes one file for each part, in time order of writing; returns the sums and the query."""
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    schema = "piece_id long, onset long, pitch long, time timestamp"
    stream = spark.readStream.schema(schema).parquet(str(src))
    q = mtp.difference_counts(stream, slices=3, **options).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        for part in parts:
            spark.createDataFrame([(p, o, k, moment(o)) for p, o, k in part], schema).coalesce(1).write.mode("append").parquet(str(src))
            q.processAllAvailable()
            between(q)
    finally:
        q.stop()
    found = mtp.sizes(spark.read.schema("piece_id long, d_onset long, d_pitch long, n long").parquet(str(out)))
    return {(r.piece_id, r.d_onset, r.d_pitch): r.size for r in found.collect()}, q


def batch_sizes(spark, notes):
    df = spark.createDataFrame(list(set(notes)), "piece_id long, onset long, pitch long")
    return {(r.piece_id, r.d_onset, r.d_pitch): r.size for r in geometry.mtps(df).collect()}


@pytest.mark.parametrize("sizes", [[], [1, 2, 50]])
def test_any_batches_give_the_sizes_of_all_mtps(spark, tmp_path, sizes):
    parts = batches(1, sizes, in_order=False)
    got, q = run(spark, tmp_path, parts, late="1000 days")
    assert got == batch_sizes(spark, [n for p in parts for n in p])
    assert any(s["operatorName"] == "transformWithStateInPandasExec" and s["numRowsTotal"] > 0 for s in mtp.state_size(q))


def test_late_rows_are_dropped(spark, tmp_path):
    first, second = [(1, o, 60) for o in range(0, 40, 4)], [(1, 50, 61)]
    late, last = [(1, 3, 60), (1, 48, 64)], [(1, 60, 60)]
    got, q = run(spark, tmp_path, [first, second, late, last], late="5 hours")
    assert got == batch_sizes(spark, [*first, *second, (1, 48, 64), *last])
    assert sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"]) >= 1


def test_notes_are_evicted_behind_the_horizon(spark, tmp_path):
    r = random.Random(5)
    notes = sorted({(1, o, r.randrange(60, 64)) for o in range(0, 200)}, key=lambda n: n[1])
    parts = [notes[i : i + 20] for i in range(0, len(notes), 20)]
    held = []

    def between(q):
        held.append(sum(s["numRowsTotal"] for s in mtp.state_size(q) if "transformWithState" in s["operatorName"]))

    got, _ = run(spark, tmp_path, parts, between, late="0 seconds", horizon_ms=10 * HOUR)
    want = Counter((1, b[1] - a[1], b[2] - a[2]) for a in notes for b in notes if a[1:] < b[1:] and b[1] - a[1] <= 10)
    assert got == want
    assert max(held[4:]) <= 2 * max(held[:3])  # the state doesn't grow with the stream


def test_running_sizes_of_a_stream_of_increments(spark, tmp_path):
    rows = [(1, 1, 0, 2), (1, 1, 0, 3), (2, 1, 0, 1)]
    spark.createDataFrame(rows, "piece_id long, d_onset long, d_pitch long, n long").write.parquet(str(tmp_path / "i"))
    stream = spark.readStream.schema("piece_id long, d_onset long, d_pitch long, n long").parquet(str(tmp_path / "i"))
    q = mtp.sizes(stream).writeStream.outputMode("complete").format("memory").queryName("sizes").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("select * from sizes").collect())) == [(1, 1, 0, 5), (2, 1, 0, 1)]
