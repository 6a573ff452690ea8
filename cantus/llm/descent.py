"""Near-duplicate embeddings by NN-descent.

A neighbour graph starts from random-projection orders and is refined by local joins: neighbours of a vector (forward and
reverse) are compared with each other, and every list keeps its best. Lists that are still over the threshold at their
end are saturated: they may hide links. They are made four times as long and refined again; there may be more links than
lists should carry. Most of these lie within a component, so vectors whose lists were saturated get a second
list, of neighbours outside theirs, which is refined alike until no component meets another. An exact check follows: links inside a
component are counted in blocks, and a brute-force audit on a sample of rows measures recall; if it still misses a
link, all components are compared with each other exhaustively.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._kernels import mix
from ._store import Store, small

#: Length of a neighbour list, and of one that was saturated, number of random-projection orders, rows that are compared at once in an order.
K, LONGEST, ORDERS, RUN = 10, 40, 12, 256
#: Most reverse neighbours in one local join; more make further joins.
REVERSE = 24
#: Rows of a block when a component's links are counted, rows that are multiplied at once, and rows of the audit's sample.
BLOCK, STRIP, AUDIT = 4096, 512, 400
#: Rows of a block when all components are compared with each other.
WIDE = 4096
#: Members (on average) of a component in a thinned order, where a run passes many components.
THIN = 16
#: What rounding of the search's half-precision vectors may take from a similarity.
SLACK = 0.004


def grouped(batches: Iterator[pa.RecordBatch], key: list[str], each: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Runs each(table, where groups begin) on whole groups of rows that come sorted by key."""
    held: list[pa.RecordBatch] = []

    def begins(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in key:
            v = t[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        b = begins(t)
        if b[-1]:
            out = each(t.slice(0, b[-1]), b)
            if out is not None:
                yield out
        held = t.slice(b[-1]).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        if t.num_rows:
            out = each(t, np.concatenate([begins(t), [t.num_rows]]))
            if out is not None:
                yield out


def vectors(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def lists(ids: np.ndarray, near: list[np.ndarray], sims: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array([x.astype(np.int64).tobytes() for x in near], pa.binary()), pa.array([x.astype(np.float32).tobytes() for x in sims], pa.binary())], names=["id", "near", "sims"])


LIST = "id long, near binary, sims binary"


def best(near: np.ndarray, sims: np.ndarray, k: int, over: float = 2.0, most: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The k most similar distinct neighbours, or up to `most` if they are as similar as `over`; ties by the smaller id."""
    o = np.lexsort((near, -sims))
    near, sims = near[o], sims[o]
    first = np.sort(np.unique(near, return_index=True)[1])
    first = first[: max(k, min(most, int((sims[first] >= over).sum())))]
    return near[first], sims[first]


def embedding_links(table: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", rounds: int = 5, seed: int = 7) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors of at least this cosine, in double precision), component_id (the
    smallest vec_id reachable by links, itself included), kept (it is that id), n_listed (how many of the links the
    neighbour lists held, before the exact check), audit_recall and list_recall (for all rows the same: of the audited links, the share whose ends the
    lists joined into one component, and the share that the lists themselves held).

    Vectors that are null, empty, zero, hold null or non-finite components, or have another length than most, link with
    nothing. Equal vectors are one class throughout, so copies never make pairs. Rows with a null id give no row; rows
    that repeat an id and a vector count as copies of it. Other columns are ignored; an empty table gives an empty result.
    """
    spark = table.sparkSession
    store = Store(spark)
    v = F.col("v")
    table = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null")
    sound = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = store.save(table.select("vec_id", F.when(sound, v).alias("v")).withColumn("c0", F.xxhash64("v")).withColumn("c1", F.xxhash64(F.lit(seed), "v")))
    usual = rows.where("v is not null").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if usual is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(0).cast("long").alias("n_listed"), F.lit(1.0).alias("audit_recall"), F.lit(1.0).alias("list_recall"))
    dim = usual.d
    classes = rows.where(F.size("v") == dim).groupBy("c0", "c1").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("v").flatten().to_numpy().reshape(b.num_rows, dim)
            x = x / np.abs(x).max(1, keepdims=True)
            x = x / np.sqrt((x * x).sum(1, keepdims=True))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], names=["c0", "c1", "id", "copies", "x", "q"])

    classes = store.save(classes.mapInArrow(normalise, "c0 long, c1 long, id long, copies long, x binary, q binary"))
    n = classes.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def side(df: DataFrame, row_bytes: int) -> DataFrame:
        """A table of at most one row for each of the n classes, broadcast if they are few."""
        return small(df, n, row_bytes)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places of the vectors in the orders; of components with more than THIN members also in thinned ones."""
        planes = np.random.default_rng(seed).standard_normal((dim, ORDERS * 30)).astype(np.float32)
        weights = 1 << np.arange(29, -1, -1, dtype=np.int64)
        for b in batches:
            bits = (vectors(b.column("q"), np.float16).astype(np.float32) @ planes > 0).reshape(b.num_rows, ORDERS, 30)
            size, ids = b.column("size").to_numpy(), b.column("id").to_numpy()
            for t in range(ORDERS):
                row = pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, t, np.int32)), pa.array((bits[:, t] * weights).sum(1)), b.column("id"), b.column("comp"), b.column("q")], names=["t", "code", "id", "comp", "q"])
                yield row
                if thinned:
                    some = mix(ids.astype(np.uint64) ^ mix(np.full(len(ids), t, np.uint64))) % size.astype(np.uint64) < THIN
                    yield row.set_column(0, "t", pa.array(np.full(b.num_rows, t + ORDERS, np.int32))).filter(pa.array(some))

    def start(length: int):
        def each(t: pa.Table, begins: np.ndarray) -> pa.RecordBatch:
            ids, comp, x = t["id"].to_numpy(), t["comp"].to_numpy(), vectors(t["q"], np.float16).astype(np.float32)
            own, near, sims = [], [], []
            for a, b in zip(begins, begins[1:]):
                for c in range(a, b, RUN):
                    d = min(c + RUN, b)
                    c = max(a, d - RUN)  # the last run is filled up from the one before
                    s = x[c:d] @ x[c:d].T
                    s[comp[c:d, None] == comp[None, c:d]] = -2
                    k = min(length, d - c - 1)
                    if k < 1:
                        continue
                    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                    for i in np.flatnonzero(s.max(1) > -2):
                        use = top[i][s[i, top[i]] > -2]
                        own.append(ids[c + i])
                        near.append(ids[c + use])
                        sims.append(s[i, use])
            return lists(np.array(own, np.int64), near, sims)

        def in_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:  # a batch is a stretch of one order, or of a few
                yield from grouped(iter([b]), ["t"], each, 1)

        return in_runs

    near_enough = threshold - SLACK

    def merged(found: DataFrame, length: int = K) -> DataFrame:
        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                near, sims = [], []
                for x, y in zip(b.column("near").to_pylist(), b.column("sims").to_pylist()):
                    p, q = best(np.frombuffer(b"".join(x), np.int64), np.frombuffer(b"".join(y), np.float32), K, near_enough, length)
                    near.append(p)
                    sims.append(q)
                yield lists(b.column("id").to_numpy(), near, sims)

        return store.save(found.groupBy("id").agg(F.collect_list("near").alias("near"), F.collect_list("sims").alias("sims")).mapInArrow(merge, LIST))

    def arrows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, sims = b.column("near").to_pylist(), b.column("sims").to_pylist()
            size = np.array([len(x) // 8 for x in near])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("id").to_numpy(), size)), pa.array(np.frombuffer(b"".join(near), np.int64)), pa.array(np.frombuffer(b"".join(sims), np.float32))], names=["a", "b", "sim"])

    def join_locally(length: int):
        def each(t: pa.Table, begins: np.ndarray) -> pa.RecordBatch:
            ids, comp, x, least = t["m"].to_numpy(), t["comp"].to_numpy(), vectors(t["q"], np.float16).astype(np.float32), t["least"].to_numpy()
            own, near, sims = [], [], []
            for a, b in zip(begins, begins[1:]):
                s = x[a:b] @ x[a:b].T
                s[comp[a:b, None] == comp[None, a:b]] = -2
                better = s > least[a:b, None]
                for i in np.flatnonzero(better.any(1)):
                    p, q = best(ids[a:b][better[i]], s[i][better[i]], K, near_enough, length)
                    own.append(ids[a + i])
                    near.append(p)
                    sims.append(q)
            return lists(np.array(own, np.int64), near, sims)

        return lambda batches: grouped(batches, ["g", "part"], each)

    def pairs(graph: DataFrame) -> DataFrame:
        return graph.mapInArrow(arrows, "a long, b long, sim float")

    def orders(of: DataFrame, length: int = K) -> DataFrame:
        """Lists of the best `length` in runs of the orders; of: (id, comp, size, q), where vectors of one comp are no neighbours."""
        return of.mapInArrow(project, "t int, code long, id long, comp long, q binary").repartitionByRange(parts, "t", "code").sortWithinPartitions("t", "code", "id").mapInArrow(start(length), LIST)

    def refine(forward: DataFrame, graph: DataFrame, of: DataFrame, length: int = K) -> DataFrame:
        """graph, after vectors that share a neighbour in forward (a, b) have been compared; lists that are full of near
        enough neighbours may grow to `length`."""
        degree = forward.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / REVERSE).cast("int").alias("parts")).withColumnRenamed("b", "g")
        ahead = forward.select(F.col("a").alias("g"), F.col("b").alias("m")).join(side(degree, 16), "g", "left")
        ahead = ahead.select("g", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), "m")
        back = forward.select(F.col("b").alias("g"), F.col("a").alias("m")).join(side(degree, 16), "g").select("g", F.pmod(F.xxhash64("m"), F.col("parts")).cast("int").alias("part"), "m")
        least = pairs(graph).groupBy("a").agg(F.when(F.count(F.lit(1)) >= length, F.min("sim")).when(F.count(F.lit(1)) >= K, F.least(F.min("sim"), F.lit(near_enough).cast("float"))).alias("least")).withColumnRenamed("a", "m")
        members = ahead.unionByName(back).join(side(of.select(F.col("id").alias("m"), "comp", "q"), 2 * dim + 48), "m").join(side(least, 16), "m", "left")
        members = members.withColumn("least", F.coalesce("least", F.lit(-2.0).cast("float")))
        found = members.repartition(parts, "g", "part").sortWithinPartitions("g", "part", "m").mapInArrow(join_locally(length), LIST)
        return merged(found.unionByName(graph), length)

    x, y = classes.select(F.col("id").alias("a"), F.col("x").alias("xa")), classes.select(F.col("id").alias("b"), F.col("x").alias("xb"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ok = (vectors(b.column("xa"), np.float64) * vectors(b.column("xb"), np.float64)).sum(1) >= threshold
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok))

    def links(graph: DataFrame) -> DataFrame:
        near = pairs(graph).where(F.col("sim") >= near_enough)
        near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return store.save(near.join(side(x, 8 * dim + 40), "a").join(side(y, 8 * dim + 40), "b").mapInArrow(confirm, "a long, b long"))

    sample = classes.orderBy(F.xxhash64("id", F.lit(1)), "id").select("id", "x").limit(AUDIT).collect()
    asked = spark.sparkContext.broadcast((np.array([r.id for r in sample], np.int64), np.frombuffer(b"".join(r.x for r in sample), np.float64).reshape(len(sample), dim)))

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = asked.value
        for b in batches:
            if b.num_rows:
                own = b.column("id").to_numpy()
                i, j = np.nonzero((q @ vectors(b.column("x"), np.float64).T >= threshold) & (ids[:, None] != own[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], own[j])), pa.array(np.maximum(ids[i], own[j]))], names=["a", "b"])

    truth = store.save(classes.mapInArrow(audit, "a long, b long").distinct())
    n_truth = truth.count()

    def hits(label: DataFrame) -> int:
        """Audited links whose ends are in one component, where all links are counted below."""
        ends = truth.join(side(label.select(F.col("id").alias("a"), F.col("component").alias("ca")), 24), "a", "left").join(side(label.select(F.col("id").alias("b"), F.col("component").alias("cb")), 24), "b", "left")
        return ends.where("ca = cb").count()

    thinned = False
    single = classes.select("id", F.col("id").alias("comp"), F.lit(1).cast("long").alias("size"), "q")
    graph = merged(orders(single))
    done, total = 0, None
    while done < rounds:  # until the lists hardly change
        graph, done, before = refine(pairs(graph), graph, single), done + 1, total
        total = pairs(graph).agg(F.sum(1 + F.col("sim"))).first()[0] or 0.0
        if before is not None and total - before <= 0.001 * before:
            break
    found = links(graph)
    label = components(store, found, n)
    while done < rounds and hits(label) < n_truth:
        graph, done = refine(pairs(graph), graph, single), done + 1
        found = links(graph)
        label = components(store, found, n)

    def full_lists(length: int) -> DataFrame:
        counts = pairs(graph).groupBy("a").agg(F.count(F.lit(1)).alias("k"), F.min("sim").alias("s"))
        return store.save(counts.where((F.col("k") >= length) & (F.col("s") >= near_enough)).select(F.col("a").alias("id")))

    def between(ids: DataFrame, graph: DataFrame) -> DataFrame:
        ends = [side(ids.withColumnRenamed("id", c), 16) for c in "ab"]
        return store.save(pairs(graph).join(ends[0], "a", "left_semi").join(ends[1], "b", "left_semi").select("a", "b"))

    def apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
        """Pairs (a, b) whose ends are in different components."""
        for c in "ab":
            pairs = pairs.join(side(label.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")), 24), c, "left")
        return pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    # Saturated lists are made longer.
    full, short = full_lists(K), graph
    if full.take(1):
        graph = merged(graph.unionByName(orders(single.join(side(full, 16), "id", "left_semi"), LONGEST)), LONGEST)
        graph = refine(between(full, short), graph, single, LONGEST)
        found = links(graph)
        if apart(found, label).take(1):
            label = components(store, found, n)

    # What was saturated: neighbours outside the own component, until none is a link.
    thinned = True

    def saturated() -> DataFrame:
        of = full.join(side(label, 24), "id", "left").select("id", F.coalesce("component", "id").alias("comp")).join(side(classes.select("id", "q"), 2 * dim + 40), "id")
        return store.save(of.join(side(full.join(side(label, 24), "id", "left").groupBy(F.coalesce("component", "id").alias("comp")).agg(F.count(F.lit(1)).alias("size")), 24), "comp"))

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield lists(b.column("a").to_numpy(), list(b.column("b").to_numpy()), list(b.column("sim").to_numpy()))

    of = saturated()
    if of.select("comp").distinct().limit(2).count() > 1:
        inner = between(full, short)
        outer = merged(orders(of))
        idle = 0
        while True:
            outer = refine(inner.unionByName(pairs(outer).select("a", "b")).distinct(), outer, of)
            new = links(outer)
            if not new.count():
                idle += 1
                if idle > 1 and (hits(label) == n_truth or idle >= rounds):
                    break
                continue
            idle = 0
            found = store.save(found.unionByName(new))
            label = components(store, found, n)
            of = saturated()
            still = pairs(outer).join(side(of.select(F.col("id").alias("a"), F.col("comp").alias("ca")), 24), "a").join(side(of.select(F.col("id").alias("b"), F.col("comp").alias("cb")), 24), "b").where("ca <> cb")
            outer = merged(orders(of).unionByName(still.select("a", "b", "sim").mapInArrow(alone, LIST)))

    listed = found.distinct()

    def compare(t: pa.Table) -> pa.Table:
        i, j, own, comp, v = t["i"][0].as_py(), t["j"][0].as_py(), t["own"].to_numpy(), t["comp"].to_numpy(), vectors(t["x"], np.float64)
        p, q = np.flatnonzero(own == i), np.flatnonzero(own == j)
        met = [np.zeros((0, 2), np.int64)]
        for c in range(0, len(p), BLOCK):
            r = p[c : c + BLOCK]
            k, m = np.nonzero((v[r] @ v[q].T >= threshold) & (comp[r, None] != comp[None, q]))
            met.append(np.unique(np.stack([comp[r[k]], comp[q[m]]], 1), axis=0))
        met = np.unique(np.sort(np.concatenate(met), 1), axis=0)
        return pa.table({"a": met[:, 0], "b": met[:, 1]})

    hit = hits(label)
    recall = hit / n_truth if n_truth else 1.0
    held = truth.join(listed.select("a", "b"), ["a", "b"], "left_semi").count()
    list_recall = held / n_truth if n_truth else 1.0
    if hit < n_truth:
        logging.getLogger(__name__).warning("NN-descent joined %d of %d audited links; components are compared exhaustively", hit, n_truth)
        blocks = -(-n // WIDE)
        every = classes.select("id", "x").join(side(label, 24), "id", "left").select(F.coalesce("component", "id").alias("comp"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("own"), "x")
        every = every.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "comp", "x")
        found = store.save(found.unionByName(every.groupBy("i", "j").applyInArrow(compare, "a long, b long")))
        label = components(store, found, n)

    # Links of a class lie within its component; they are counted there exactly, in blocks of bounded size.
    members = label.join(side(classes.select("id", "copies", "x"), 8 * dim + 48), "id")
    sizes = label.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    members = members.join(side(sizes, 24), "component").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    bins = max(1, label.count() // (2 * BLOCK))
    large = members.where("blocks > 1").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    few = members.where("blocks = 1").select(F.pmod(F.xxhash64("component"), F.lit(bins)).alias("g"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), "component", F.lit(0).alias("own"), "id", "copies", "x")
    many = large.select(F.col("component").alias("g"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "component", "own", "id", "copies", "x")

    def count(t: pa.Table) -> pa.Table:
        t = t.sort_by([("component", "ascending"), ("id", "ascending")])
        comp, ids, w, own = t["component"].to_numpy(), t["id"].to_numpy(), t["copies"].to_numpy(), t["own"].to_numpy()
        x = vectors(t["x"], np.float64)
        out = np.zeros(len(ids), np.int64)
        cut = np.flatnonzero(np.concatenate([[True], comp[1:] != comp[:-1], [True]]))
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        for a, b in zip(cut, cut[1:]):
            for c in range(a, b, STRIP):
                d = min(c + STRIP, b)
                link = x[c:d] @ x[a:b].T >= threshold
                link[np.arange(d - c), np.arange(c - a, d - a)] = False
                if i != j:
                    link &= own[c:d, None] != own[None, a:b]  # pairs within a block are counted by the block with itself
                out[c:d] = link @ w[a:b]
        return pa.table({"id": ids, "links": out})

    counts = few.unionByName(many).groupBy("g", "i", "j").applyInArrow(count, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
    copies = classes.select(F.col("id").alias("b"), "copies")
    listed = listed.unionByName(listed.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(side(copies, 24), "b").groupBy(F.col("a").alias("id")).agg(F.sum("copies").alias("listed"))
    judged = classes.select("c0", "c1", "id", "copies").join(side(label, 24), "id", "left").join(side(counts, 24), "id", "left").join(side(listed, 24), "id", "left")
    judged = judged.select("c0", "c1", F.coalesce("component", "id").alias("class"), *((F.coalesce(c, F.lit(0)) + F.col("copies") - 1).alias(c) for c in ("links", "listed")))
    out = rows.select("vec_id", "c0", "c1").join(side(judged, 56), ["c0", "c1"], "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class", "vec_id").alias("component_id"), F.coalesce("listed", F.lit(0)).cast("long").alias("n_listed"))
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"), "n_listed", F.lit(recall).alias("audit_recall"), F.lit(list_recall).alias("list_recall"))
