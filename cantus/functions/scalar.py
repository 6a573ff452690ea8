"""Column expressions: rounding, bins, spans, overlaps, pitch and degree maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pitch-class names (fixed values).
PITCH_NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def centibeat(x: Column) -> Column:
    """Hundredths of a beat, half to even."""
    return F.bround(x * 100, 0).cast("long")


def centibeat_floor(x: Column) -> Column:
    """Hundredths of a beat, cut towards zero."""
    return (x * 100).cast("long")


def bin_of(x: Column, edges: Sequence[float]) -> Column:
    """Index of the bin that x falls in; what lies outside goes to the first or last bin. Bins are closed on the left."""
    at = sum((F.when(x >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    return at.cast("int")


def nearest(x: Column, step: float, count: int, first: float | None = None) -> Column:
    """Index of the nearest of count grid points first, first + step, ...; ties go to the lower one."""
    first = step if first is None else first
    return F.greatest(F.lit(0), F.least(F.lit(count - 1), F.ceil((x - first) / step - 0.5))).cast("int")


def time_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over hull of two spans; 0 for an empty hull."""
    overlap = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))
    hull = F.greatest(e1, e2) - F.least(s1, s2)
    return F.when(hull > 0, overlap / hull).otherwise(F.lit(0.0))


def overlap_ratio(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over the shorter span; 0 if that is empty."""
    shorter = F.least(e1 - s1, e2 - s2)
    return F.when(shorter > 0, F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2)) / shorter).otherwise(F.lit(0.0))


def tempo_penalty(g1: Column, g2: Column, alpha: float) -> Column:
    return F.exp(-alpha * F.abs(g1 - g2))


def jaccard(both: Column, n1: Column, n2: Column) -> Column:
    """From the sizes of an intersection and of two sets; two empty sets are equal."""
    union = n1 + n2 - both
    return F.when(union > 0, both / union).otherwise(F.lit(1.0))


def scale_of(span: Column, scales: Sequence[float], mode: str = "ceil") -> Column:
    """The smallest scale that covers the span, or `>largest`; with mode `closest` the nearest, ties to the smaller."""
    scales = sorted(scales)
    name = lambda s: F.lit(f"{s:g}")
    if mode == "closest":
        out = name(scales[-1])
        for low, high in reversed(list(zip(scales, scales[1:]))):
            out = F.when(F.abs(span - low) <= F.abs(span - high), name(low)).otherwise(out)
        return out
    out = F.lit(f">{scales[-1]:g}")
    for s in reversed(scales):
        out = F.when(span <= s, name(s)).otherwise(out)
    return out


def pitch_name(pitch: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, PITCH_NAMES)), (F.pmod(pitch, F.lit(12)) + 1).cast("int"))


def degree(text: Column) -> tuple[Column, Column]:
    """(degree, secondary) of scale degrees such as 1, -2, +4, 5/5: from 0, sharpened by 7, flattened by 14; without a slash the secondary is 0."""

    def one(part: Column) -> Column:
        digit = F.regexp_extract(part, "([0-9])", 1).cast("int") - 1
        return digit + F.when(part.startswith("+"), 7).when(part.startswith("-"), 14).otherwise(0)

    parts = F.split(text, "/")
    return one(parts[0]), F.coalesce(F.when(F.size(parts) > 1, one(F.get(parts, F.lit(1)))), F.lit(0))


def tempo_class(bpm: Column) -> tuple[Column, Column]:
    """(class, offset) of a tempo: slow 30-89, mid 90-149, fast 150-209; beyond, the ends."""
    kind = F.when(bpm < 90, "slow").when(bpm < 150, "mid").otherwise("fast")
    low = F.when(bpm < 90, 30).when(bpm < 150, 90).otherwise(150)
    return kind, F.greatest(F.lit(0), F.least(F.lit(59), bpm - low)).cast("int")


def vec(points: Column) -> Column:
    """Differences of consecutive points of an array of (onset, pitch)."""
    n = F.size(points)
    return F.zip_with(
        F.slice(points, 2, F.greatest(n - 1, F.lit(0))),
        F.slice(points, 1, F.greatest(n - 1, F.lit(0))),
        lambda b, a: F.struct((b["onset"] - a["onset"]).alias("onset"), (b["pitch"] - a["pitch"]).alias("pitch")),
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column, least: float = 1e-9) -> Column:
    """A vector over its length; a vector shorter than `least` becomes zeros."""
    norm = F.sqrt(dot(a, a))
    return F.when(norm < least, F.transform(a, lambda x: F.lit(0.0))).otherwise(F.transform(a, lambda x: x.cast("double") / norm))


#: Lower edges of velocity bins (fixed values).
VELOCITIES = (0, 32, 48, 64, 80, 96, 128)
#: Semitones of the note letters, and chord qualities in the order of their numbers (fixed values).
LETTERS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
QUALITIES = ("M", "m", "d", "a", "M7", "m7", "D7", "d7", "h7", "a6")


def velocity_bin(velocity: Column, edges: Sequence[int] = VELOCITIES) -> Column:
    """Index of the last edge that is not over the velocity."""
    return (sum((F.when(velocity >= e, 1).otherwise(0) for e in edges), F.lit(0)) - 1).cast("int")


def tonic_number(key: Column) -> Column:
    """A key such as C, f+ or b- as a number: semitones over C, and 12 more for minor (small letters), null if it isn't a key.

    As in the published tables only minor keys with flats, e+ and b+ come out as minor; other small letters count as major.
    """
    letter, sign = F.upper(F.substring(key, 1, 1)), F.substring(key, 2, 2)
    step = F.element_at(F.create_map(*(F.lit(x) for pair in LETTERS.items() for x in pair)), letter)
    alter = F.when(sign == "", 0).when(sign == "+", 1).when(sign == "-", -1)
    minor = key.rlike("^[a-g]") & ((sign == "-") | (sign == "+") & letter.isin("E", "B"))
    return F.when(key.rlike("^[A-Ga-g][+-]?$"), F.pmod(step + alter, F.lit(12)) + F.when(minor, 12).otherwise(0)).cast("int")


def quality_number(quality: Column) -> Column:
    """A chord quality's number, null if it isn't one."""
    return F.nullif(F.array_position(F.array(*map(F.lit, QUALITIES)), quality), F.lit(0)).cast("int") - 1


def boundary(kind: Column) -> tuple[Column, Column]:
    """(label, flag) of a note's motif: without one the label z and 0."""
    return F.when(kind == "", "z").otherwise(kind), F.when(kind == "", 0).otherwise(1)


def logged_metrics(text: Column) -> Column:
    """A struct of precision, recall and f1 of the three metrics that a run's log gives; null where it gives none."""

    def of(name: str) -> Column:
        pattern = f"Mean_{name} P ([0-9.]+), R ([0-9.]+), F ([0-9.]+)"
        found = [F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).cast("double") for k in (1, 2, 3)]
        return F.struct(*(v.alias(n) for v, n in zip(found, ("precision", "recall", "f1"))))

    return F.struct(of("est").alias("establishment"), of("occ").alias("occurrence"), of("thr").alias("three_layer"))


#: Points of the midpoint rule.
GRID = 4000


def t_tail(t: Column, freedom: Column, grid: int = GRID) -> Column:
    """P(T > t) of Student's distribution. The density up to its constant is summed by the midpoint rule over u = s / (1 + s)."""

    def area(upto: Column) -> Column:
        def height(k: Column) -> Column:
            u = (k + 0.5) / grid * upto
            return F.pow(1 + F.pow(u / (1 - u), 2) / freedom, -(freedom + 1) / 2) / F.pow(1 - u, 2)

        return upto * F.aggregate(F.sequence(F.lit(0), F.lit(grid - 1)), F.lit(0.0), lambda s, k: s + height(k))

    half = area(F.abs(t) / (1 + F.abs(t))) / area(F.lit(1.0)) / 2
    return F.when(t >= 0, 0.5 - half).otherwise(0.5 + half)
