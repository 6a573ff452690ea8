"""Precision and recall of discovered patterns against reference patterns, from the overlap of their occurrences.

Pattern sets are rows (piece_id, pattern, occ, onset, pitch). Pairs of occurrences that share no note have score 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import t_tail

OCC = ["piece_id", "pattern", "occ"]


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def share(a: Column, b: Column) -> Column:
    """a / b of two counts (below 10^10) to 28 places. Sums of such shares are the same in every order, those of doubles are not, and
    a mean that lies halfway between two rounded figures would fall to either side by the order of its rows."""
    return a.cast("decimal(27,17)") / b.cast("decimal(10,0)")


def score_matrix(ref: DataFrame, est: DataFrame) -> DataFrame:
    """(piece_id, rp, ro, ep, eo, shared, nr, ne, score): every reference against every estimated occurrence of a piece; the
    score is the number of shared notes over the larger number."""
    a = ref.groupBy(*OCC).agg(F.count(F.lit(1)).alias("nr")).select("piece_id", F.col("pattern").alias("rp"), F.col("occ").alias("ro"), "nr")
    b = est.groupBy(*OCC).agg(F.count(F.lit(1)).alias("ne")).select("piece_id", F.col("pattern").alias("ep"), F.col("occ").alias("eo"), "ne")
    x = ref.select("piece_id", F.col("pattern").alias("rp"), F.col("occ").alias("ro"), "onset", "pitch")
    y = est.select("piece_id", F.col("pattern").alias("ep"), F.col("occ").alias("eo"), "onset", "pitch")
    shared = x.join(y, ["piece_id", "onset", "pitch"]).groupBy("piece_id", "rp", "ro", "ep", "eo").agg(F.count(F.lit(1)).alias("shared"))
    out = a.join(b, "piece_id").join(shared, ["piece_id", "rp", "ro", "ep", "eo"], "left").fillna(0, ["shared"])
    return out.withColumn("score", F.col("shared") / F.greatest("nr", "ne"))


def establishment(matrix: DataFrame) -> DataFrame:
    """Per piece: how well each estimated pattern matches some reference pattern (precision) and the other way (recall); a
    pair of patterns counts its best pair of occurrences."""
    s = matrix.groupBy("piece_id", "rp", "ep").agg(F.max("score").alias("s"))
    p = s.groupBy("piece_id", "ep").agg(F.max("s").alias("m")).groupBy("piece_id").agg(F.avg("m").alias("precision"))
    r = s.groupBy("piece_id", "rp").agg(F.max("s").alias("m")).groupBy("piece_id").agg(F.avg("m").alias("recall"))
    return p.join(r, "piece_id").withColumn("f1", f1(F.col("precision"), F.col("recall")))


def occurrence(matrix: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Per piece, over pairs of patterns that are established (best score of at least threshold): mean best score of the estimated occurrences
    (precision) and of the reference ones (recall). A pattern in several such pairs counts in each; in a pair it is given the best among
    the partners that are in any pair. Pieces without such a pair have zeros."""
    best = matrix.groupBy("piece_id", "rp", "ep").agg(F.max("score").alias("s"))
    pairs = best.where(F.col("s") >= threshold).select("piece_id", "rp", "ep")
    shares = matrix.withColumn("exact", share(F.col("shared"), F.greatest("nr", "ne")))
    col = shares.groupBy("piece_id", "rp", "ep", "eo").agg(F.max("exact").alias("m")).groupBy("piece_id", "rp", "ep").agg(F.avg("m").alias("p"))
    row = shares.groupBy("piece_id", "rp", "ep", "ro").agg(F.max("exact").alias("m")).groupBy("piece_id", "rp", "ep").agg(F.avg("m").alias("r"))
    cells = pairs.join(col, ["piece_id", "rp", "ep"]).join(row, ["piece_id", "rp", "ep"])
    by_e = cells.groupBy("piece_id", "ep").agg(F.max("p").alias("x"), F.count(F.lit(1)).alias("n"))
    by_r = cells.groupBy("piece_id", "rp").agg(F.max("r").alias("x"), F.count(F.lit(1)).alias("n"))
    total = F.sum(F.col("x").cast("decimal(27,26)") * F.col("n").cast("decimal(10,0)"))
    mean = (total / F.sum("n").cast("decimal(10,0)")).cast("double")
    p = by_e.groupBy("piece_id").agg(mean.alias("precision"))
    r = by_r.groupBy("piece_id").agg(mean.alias("recall"))
    out = matrix.select("piece_id").distinct().join(p, "piece_id", "left").join(r, "piece_id", "left").fillna(0.0)
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def three_layer(matrix: DataFrame) -> DataFrame:
    """Per piece: F1 of notes for pairs of occurrences, of it F1 for pairs of patterns, and of that for the piece."""
    n = matrix.withColumn("l1", f1(F.col("shared") / F.col("ne"), F.col("shared") / F.col("nr")))
    pat = ["piece_id", "rp", "ep"]
    p = n.groupBy(*pat, "eo").agg(F.max("l1").alias("m")).groupBy(*pat).agg(F.avg("m").alias("p"))
    r = n.groupBy(*pat, "ro").agg(F.max("l1").alias("m")).groupBy(*pat).agg(F.avg("m").alias("r"))
    l2 = p.join(r, pat).withColumn("l2", f1(F.col("p"), F.col("r")))
    p = l2.groupBy("piece_id", "ep").agg(F.max("l2").alias("m")).groupBy("piece_id").agg(F.avg("m").alias("precision"))
    r = l2.groupBy("piece_id", "rp").agg(F.max("l2").alias("m")).groupBy("piece_id").agg(F.avg("m").alias("recall"))
    return p.join(r, "piece_id").withColumn("f1", f1(F.col("precision"), F.col("recall")))


def first_patterns(est: DataFrame, n: int = 5) -> DataFrame:
    """The first n patterns of each piece."""
    ids = est.select("piece_id", "pattern").distinct()
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("piece_id").orderBy("pattern"))
    return est.join(ids.withColumn("k", rank).where(F.col("k") <= n).drop("k"), ["piece_id", "pattern"])


def forms(patterns: DataFrame) -> DataFrame:
    """(piece_id, pattern, form): each pattern's first occurrence, moved so that it begins at the origin, as text."""
    from .geometry import point, shape

    first = patterns.groupBy("piece_id", "pattern").agg(F.min("occ").alias("occ"))
    points = patterns.join(first, ["piece_id", "pattern", "occ"]).groupBy("piece_id", "pattern").agg(F.sort_array(F.collect_list(point())).alias("points"))
    return points.select("piece_id", "pattern", F.array_join(F.transform(shape(F.col("points")), lambda p: F.concat_ws(":", p["onset"], p["pitch"])), " ").alias("form"))


def translational(ref: DataFrame, est: DataFrame) -> DataFrame:
    """Per piece: shares of estimated patterns that equal some reference pattern up to translation (precision), and the other way (recall)."""
    a, b = forms(ref), forms(est)
    p = b.join(a.select("piece_id", "form").distinct().withColumn("hit", F.lit(1.0)), ["piece_id", "form"], "left").groupBy("piece_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("precision"))
    r = a.join(b.select("piece_id", "form").distinct().withColumn("hit", F.lit(1.0)), ["piece_id", "form"], "left").groupBy("piece_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))
    return r.join(p, "piece_id", "left").fillna(0.0)


def confusion(rows: DataFrame, gold: Column, guess: Column) -> DataFrame:
    """Counts of a binary classification and f1, accuracy, precision, recall; ratios over nothing are 0."""
    t, g = gold.cast("boolean"), guess.cast("boolean")
    counts = rows.agg(*(F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias(n) for n, c in (("tp", t & g), ("fp", ~t & g), ("fn", t & ~g), ("tn", ~t & ~g))))
    p, r = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    return counts.select("*", ((F.col("tp") + F.col("tn")) / F.greatest(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), F.lit(1))).alias("accuracy"), p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def melody_accuracy(notes: DataFrame, melody: DataFrame, by: list[str], wide: Column, narrow: Column) -> DataFrame:
    """Four counts for each of two readings of which notes are melody (with and without bridge): found or not (by a semi-join on `by`) against labelled or not."""
    rows = notes.join(melody.select(*by).distinct().withColumn("found", F.lit(True)), by, "left").withColumn("found", F.coalesce("found", F.lit(False)))
    out = []
    for name, gold in (("wide", wide), ("narrow", narrow)):
        for label, c in (("tp", gold & F.col("found")), ("fp", ~gold & F.col("found")), ("fn", gold & ~F.col("found")), ("tn", ~gold & ~F.col("found"))):
            out.append(F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias(f"{name}_{label}"))
    return rows.agg(*out)


def welch(rows: DataFrame, group: Column, value: Column) -> DataFrame:
    """Welch's statistic of two samples (group true and false), and its degrees of freedom."""
    s = rows.agg(*(f(F.when(group if k else ~group, value)).alias(f"{n}{k}") for k in (1, 0) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))))
    a, b = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    return s.select(((F.col("m1") - F.col("m0")) / F.sqrt(a + b)).alias("t"), ((a + b) ** 2 / (a * a / (F.col("n1") - 1) + b * b / (F.col("n0") - 1))).alias("freedom"))


def welch_test(rows: DataFrame, group: Column, value: Column) -> DataFrame:
    """welch with p_greater, the chance of such a statistic or a larger one if the groups don't differ."""
    return welch(rows, group, value).withColumn("p_greater", t_tail(F.col("t"), F.col("freedom")))


def mean_interval(rows: DataFrame, value: Column, level: float = 0.95) -> DataFrame:
    """(mean, low, high): a mean with its interval by Student's distribution, whose quantile is found by halving."""
    s = rows.agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"), (F.count(value) - 1).cast("double").alias("freedom"))
    tail = (1 - level) / 2
    halves = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))

    def halve(b: Column, _: Column) -> Column:
        mid = (b["low"] + b["high"]) / 2
        over = t_tail(mid / (1 - mid), F.col("freedom"), 1000) > tail
        return F.struct(F.when(over, mid).otherwise(b["low"]).alias("low"), F.when(over, b["high"]).otherwise(mid).alias("high"))

    u = F.aggregate(F.sequence(F.lit(1), F.lit(40)), halves, halve)["low"]
    half = F.col("se") * u / (1 - u)
    return s.select("mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def same_and_different(vectors: DataFrame) -> DataFrame:
    """(group, id, label, u: unit vector) to the number and mean cosine of pairs of a group with the same label and with
    different ones. Sums of vectors give both, without any pair: (|sum|^2 - sum of |u|^2) / 2 is the sum over pairs."""

    def within(*by: str) -> DataFrame:
        parts = vectors.select(*by, F.posexplode("u").alias("k", "x")).groupBy(*by, "k").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
        sums = parts.groupBy(*by).agg(F.sum(F.col("s") * F.col("s")).alias("s"), F.sum("q").alias("q"))
        n = vectors.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        return sums.join(n, list(by)).select(*by, ((F.col("s") - F.col("q")) / 2).alias("total"), (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"))

    same = within("group", "label").groupBy("group").agg(F.sum("total").alias("same_total"), F.sum("pairs").alias("same_pairs"))
    out = within("group").join(same, "group").withColumn("different_pairs", F.col("pairs") - F.col("same_pairs"))
    mean = lambda t, n: F.when(n > 0, t / n)
    return out.select("group", "same_pairs", "different_pairs", mean(F.col("same_total"), F.col("same_pairs")).alias("same_mean"), mean(F.col("total") - F.col("same_total"), F.col("different_pairs")).alias("different_mean"))
