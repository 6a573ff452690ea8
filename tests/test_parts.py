"""Queries that go by parts of the pieces: the rows are those of the whole, and what they wrote on the way is gone when they return."""

import random
from pathlib import Path

import duckdb
import pytest

from cantus.operators import cover, discover, graph
from cantus.operators import geometry as g
from tests.test_geometry import points
from tests.test_queries import DATA, QUERIES, rows

#: By finding of the review's fourth round.
IN_PARTS = ["compress_cover", "compress_cover_conjugates", "siatec_cs_motifs", "siatec_motifs", "compress_cover_strict", "cosiatec_cover", "default_motifs", "retrieval_sweep_top", "top_neighbours", "tec_salience", "cr_statistics", "forth_cover", "siatech_pf", "tec_measures", "tec_membership", "tec_ranking", "occurrences", "siatechf"]


def shuffles(spark):
    return {str(p) for p in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*")}


@pytest.fixture
def narrow(spark, monkeypatch, tmp_path):
    """Parts of few pairs, and a shared folder of the test's own."""
    monkeypatch.setattr(graph, "folder", lambda _: f"file://{tmp_path}")
    monkeypatch.setattr(graph, "PAIRS", 5000)
    return tmp_path


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", IN_PARTS)
def test_parts_have_the_rows_of_the_whole_and_leave_nothing_else(spark, narrow, monkeypatch, name):
    plan, query = QUERIES[name]
    before, made = shuffles(spark), []
    monkeypatch.setattr(graph, "passing", lambda f=graph.passing: made.append(1) or f())
    df = query(spark, str(DATA))
    assert len(made) > 1 and len(list(narrow.glob("cantus-*"))) == 1 and shuffles(spark) <= before
    if name in plan.ORACLE:
        con = duckdb.connect()
        con.sql(f"create view events as select * from '{DATA}/events.parquet'")
        rel = con.sql(plan.ORACLE[name])
        want = rows(rel.columns, rel.fetchall())
    else:
        monkeypatch.setattr(graph, "PAIRS", 1 << 30)
        whole = query(spark, str(DATA))
        want = rows(whole.columns, whole.collect())
    assert rows(df.columns, df.collect()) == want


def test_places_within_rows_and_by_a_shuffle(spark, monkeypatch):
    """Covers and their sizes are the same, however many places are told apart within a row, and however many of them are held at once."""
    r = random.Random(3)
    n = points(spark, *({(r.randrange(9), r.randrange(-3, 3)) for _ in range(25)} for _ in range(2)), {(10**12 * k, -(10**12) * k) for k in range(6)}, {(5, 5)})
    tecs = graph.written(g.siatec(n))
    want = {(*(t[c] for c in g.KEY), p["onset"] + v["onset"], p["pitch"] + v["pitch"]) for t in tecs.collect() for p in t.pattern for v in t.translators}
    for places, held in ((1 << 12, 1 << 20), (1 << 12, 7), (6, 1 << 20), (0, 1)):
        monkeypatch.setattr(g, "PLACES", places)
        monkeypatch.setattr(g, "HELD", held)
        assert sorted(map(tuple, g.covered(tecs).collect())) == sorted(want)
        sizes = {tuple(t[c] for c in g.KEY): t.coverage for t in g.with_coverage(tecs).collect()}
        assert sizes == {k: sum(w[:3] == k for w in want) for k in {w[:3] for w in want}}


def test_no_pieces(spark):
    n = points(spark)
    assert graph.in_parts(n, cover.compress).count() == 0 and discover.siatec(n).count() == 0
