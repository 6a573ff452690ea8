"""Connected components of links by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Store
from ._store import small as sized


def components(store: Store, links: DataFrame, most: int | None = None) -> DataFrame:
    """links (a, b) to (id, component): the smallest id reachable, for every id that has a link to another. most: how many ids there are at most, if that
    is known; few enough are broadcast.

    Each round rewrites the edges into flatter stars (two shuffles by the node, minima combined before them) and is
    written to the shared folder; it ends when a round changes nothing, after a number of rounds that grows with the
    logarithm of the longest path.
    """
    edges = store.save(links.where("a <> b").select(F.least("a", "b").alias("m"), F.greatest("a", "b").alias("u")).distinct())
    seen = None
    side = (lambda df: df.hint("merge")) if most is None else lambda df: sized(df, most, 16)
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.hash("m", "u").cast("long")), F.sum(F.xxhash64("u", "m").bitwiseAND((1 << 24) - 1))).first())
        if now == seen or now[0] == 0:
            return edges.select(F.col("u").alias("id"), F.col("m").alias("component")).unionByName(edges.select(F.col("m").alias("id"), F.col("m").alias("component")).distinct())
        seen = now
        both = edges.select("u", F.col("m").alias("v")).unionByName(edges.select(F.col("m").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v0")).select("u", F.least("u", "v0").alias("m"))
        large = both.join(side(least), "u").where("v > u").select(F.col("v").alias("u"), "m").distinct()
        least = large.groupBy("u").agg(F.min("m").alias("r"))
        small = large.join(side(least), "u")
        flat = small.where("m <> r").select(F.col("m").alias("u"), F.col("r").alias("m")).unionByName(least.select("u", F.col("r").alias("m"))).distinct()
        before, edges = edges, store.save(flat)
        store.drop(before)
