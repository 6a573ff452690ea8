"""Registered queries of the library against their SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from cantus.plans import evaluation, extra, geometry, more, music, retrieval, streams, training

DATA = Path("/root/testdata/sf0.001")
PLANS = (geometry, retrieval, evaluation, music, extra, more, streams, training)
QUERIES = {n: (p, q) for p in PLANS for n, q in p.QUERIES.items()}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def rows(columns, data):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(([plain(r[k]) for k in order] for r in data), key=str)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", [n for n, (p, _) in QUERIES.items() if n in p.ORACLE])
def test_query(spark, con, name):
    plan, query = QUERIES[name]
    df = query(spark, str(DATA))
    rel = con.sql(plan.ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())


def test_streaming_counts_agree_with_the_batch(spark, tmp_path):
    from cantus.streaming.counts import window_counts

    events = spark.createDataFrame([("2024-01-01 01:00:00", "a", 1.0), ("2024-01-01 02:00:00", "a", 2.0), ("2024-01-03 02:00:00", "b", 3.0)], "ts string, event_type string, value double")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = window_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("select * from counts").collect())) == sorted(map(tuple, window_counts(events).collect()))
