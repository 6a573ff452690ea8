"""Difference vectors of a growing corpus (an extension): notes arrive in any batches, the sizes of all MTPs follow.

A note is stored by one slice of its piece and shown to all of them, so that a long piece spreads over tasks: a slice pairs what it
stores with what it is shown. Pairs are counted once, whichever batches their notes come in. The counts of difference
vectors leave as increments; their sums, a second stateful aggregation or one over the written table, are the sizes of the MTPs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Pairs that are formed at once.
PAIRS = 1 << 20
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def oriented(a: np.ndarray, b: np.ndarray, horizon: int | None, ordered: bool) -> Iterator[np.ndarray]:
    """Rows (d_onset, d_pitch) of the pairs of notes (onset, pitch, time) from a and b, from the earlier to the later one; with
    ordered only those whose note of a is the earlier. Pairs further apart in time than horizon are left out."""
    step = max(1, PAIRS // max(len(b), 1))
    for i in range(0, len(a), step):
        d = (b[None, :, :] - a[i : i + step, None, :]).reshape(-1, 3)
        later = (d[:, 0] > 0) | (d[:, 0] == 0) & (d[:, 1] > 0)
        same = (d[:, 0] == 0) & (d[:, 1] == 0)
        keep = later if ordered else ~same
        if horizon is not None:
            keep &= np.abs(d[:, 2]) <= horizon
        yield np.where(later[:, None], d[:, :2], -d[:, :2])[keep]


class Differences(StatefulProcessor):
    """State of a (piece, slice): the notes it stores, one packed array for each batch that brought some."""

    def __init__(self, horizon: int | None):
        self.horizon = horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.notes = handle.getListState("notes", "packed binary")

    def stored(self) -> np.ndarray:
        held = [np.frombuffer(r[0], np.int64) for r in self.notes.get()] if self.notes.exists() else []
        return np.concatenate([np.zeros(0, np.int64), *held]).reshape(-1, 3)

    def evicted(self, old: np.ndarray, watermark: int) -> np.ndarray:
        """What of old can still be paired; the state is rewritten if that is less."""
        if self.horizon is None or not len(old):
            return old
        left = old[old[:, 2] >= watermark - self.horizon]
        if len(left) < len(old):
            if len(left):
                self.notes.put([(left.tobytes(),)])
            else:
                self.notes.clear()
        return left

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows))
        shown = came[["onset", "pitch", "ms"]].to_numpy(np.int64)
        own = shown[came["own"].to_numpy(bool)]
        old = self.evicted(self.stored(), timerValues.getCurrentWatermarkInMs())
        if len(own):
            self.notes.appendValue((own.tobytes(),))
            if self.horizon is not None and not any(True for _ in self.handle.listTimers()):
                self.handle.registerTimer(int(own[:, 2].min()) + self.horizon + 1)
        seen: dict[tuple, int] = {}
        for d in [*oriented(old, shown, self.horizon, False), *oriented(own, shown, self.horizon, True)]:
            vectors, n = np.unique(d, axis=0, return_counts=True)
            for v, k in zip(map(tuple, vectors.tolist()), n.tolist()):
                seen[v] = seen.get(v, 0) + k
        if seen:
            d_onset, d_pitch = zip(*seen)
            yield pd.DataFrame({"piece_id": key[0], "d_onset": d_onset, "d_pitch": d_pitch, "n": list(seen.values())})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        left = self.evicted(self.stored(), timerValues.getCurrentWatermarkInMs())
        if len(left):
            self.handle.registerTimer(int(left[:, 2].min()) + self.horizon + 1)
        return iter(())

    def close(self) -> None:
        pass


def difference_counts(notes: DataFrame, slices: int = 8, late: str = "0 seconds", horizon_ms: int | None = None) -> DataFrame:
    """Increments (piece_id, d_onset, d_pitch, n) of a stream of notes (piece_id, onset, pitch, time): n more pairs of the piece's
    notes differ by that vector. Their sums are the sizes of the MTPs of what has arrived.

    A note that comes again counts once. Rows later than `late` behind the watermark of `time` (the note's time, a function of its onset) are
    dropped; without a horizon all notes stay in the state, with one pairs further apart than that are not counted and
    notes are evicted when the watermark has passed them by as much. `slices` is how many keys a piece spreads over. Append mode.
    """
    once = notes.select("piece_id", "onset", "pitch", "time").where("piece_id is not null and onset is not null and pitch is not null and time is not null")
    once = once.withWatermark("time", late).dropDuplicates(["piece_id", "onset", "pitch", "time"])
    home = F.pmod(F.xxhash64("onset", "pitch"), F.lit(slices)).cast("int")
    dealt = once.withColumn("home", home).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    dealt = dealt.select("piece_id", "slice", "time", F.unix_millis("time").alias("ms"), F.col("onset").cast("long").alias("onset"), F.col("pitch").cast("long").alias("pitch"), (F.col("slice") == F.col("home")).alias("own"))
    kind = dict(notes.dtypes)["piece_id"]
    notes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return dealt.groupBy("piece_id", "slice").transformWithStateInPandas(Differences(horizon_ms), f"piece_id {kind}, d_onset long, d_pitch long, n long", "Append", "EventTime")


def sizes(increments: DataFrame) -> DataFrame:
    """(piece_id, d_onset, d_pitch, size): a table of increments summed, or a stream of them (state by piece and vector; update or complete mode)."""
    return increments.groupBy("piece_id", "d_onset", "d_pitch").agg(F.sum("n").alias("size"))


def state_size(query: StreamingQuery) -> list[dict]:
    """Rows, bytes and late rows of every stateful operator of a running or finished query, as of its last batch that says so."""
    for progress in reversed(query.recentProgress):
        if progress["stateOperators"]:
            return [{k: s[k] for k in ("operatorName", "numRowsTotal", "memoryUsedBytes", "numRowsDroppedByWatermark")} for s in progress["stateOperators"]]
    return []
