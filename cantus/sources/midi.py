"""Notes of standard MIDI files, read as binary files and parsed in the tasks that hold them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prep import note_seconds
from .notes import piece_of

#: Data bytes after a channel message, by the status's upper half (fixed values).
DATA_BYTES = {0x8: 2, 0x9: 2, 0xA: 2, 0xB: 2, 0xC: 1, 0xD: 1, 0xE: 2}


def variable_length(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    while True:
        value = (value << 7) | (data[at] & 0x7F)
        at += 1
        if not data[at - 1] & 0x80:
            return value, at


def track_notes(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, pitch, velocity) in ticks of one track. A note off ends the earliest note of its pitch that sounds."""
    at = tick = status = 0
    sounding: dict[tuple[int, int], list[tuple[int, int]]] = {}
    while at < len(data):
        delta, at = variable_length(data, at)
        tick += delta
        if data[at] & 0x80:
            status, at = data[at], at + 1
        if status in (0xFF, 0xF0, 0xF7):
            at += status == 0xFF
            size, at = variable_length(data, at)
            at += size
            continue
        kind, n = status >> 4, DATA_BYTES[status >> 4]
        args, at = data[at : at + n], at + n
        if kind in (0x8, 0x9):
            key = (status & 0xF, args[0])
            if kind == 0x9 and args[1]:
                sounding.setdefault(key, []).append((tick, args[1]))
            elif sounding.get(key):
                start, velocity = sounding[key].pop(0)
                yield start, tick, args[0], velocity


def file_notes(content: bytes) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(track, ticks per beat, start, end, pitch, velocity); tracks are numbered among those with notes."""
    if content[:4] != b"MThd":
        return
    size, _, _, division = struct.unpack(">IHHH", content[4:14])
    at, track = 8 + size, 0
    while at + 8 <= len(content):
        name, size = struct.unpack(">4sI", content[at : at + 8])
        rows = list(track_notes(content[at + 8 : at + 8 + size])) if name == b"MTrk" else []
        yield from ((track, division, *r) for r in sorted(rows))
        track += bool(rows)
        at += 8 + size


def read_midi(spark: SparkSession, path: str) -> DataFrame:
    """(piece_id, track, onset, end, pitch, velocity) in beats, of all .mid files below path. What isn't a MIDI file gives no row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.mid*").load(path).select(piece_of(F.col("path")).alias("piece_id"), "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f.piece_id, t, s / d, e / d, p, v) for f in pdf.itertuples() for t, d, s, e, p, v in file_notes(bytes(f.content))]
            yield pd.DataFrame(rows, columns=["piece_id", "track", "onset", "end", "pitch", "velocity"])

    return files.mapInPandas(parse, "piece_id string, track int, onset double, end double, pitch int, velocity int")


def motif_labels(labels: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes of labelled motifs: (piece_id, type, occ, onset, pitch), the notes of the label's track within its MIDI span, moved to the label's onset."""
    a = labels.select("piece_id", "type", "track", "start", "start_midi", "end_midi")
    n = notes.select("piece_id", "track", F.col("onset").alias("at"), "pitch")
    out = a.join(n, ["piece_id", "track"]).where("at >= start_midi and at < end_midi")
    return out.select("piece_id", "type", F.col("start").alias("occ"), F.bround(F.col("at") - F.col("start_midi") + F.col("start"), 2).alias("onset"), "pitch")


def file_tempi(content: bytes) -> list[tuple[float, float]]:
    """(beat, beats per minute) of a file's tempo events, in order; 120 from the beginning where none is there."""
    if content[:4] != b"MThd":
        return []
    size, _, _, division = struct.unpack(">IHHH", content[4:14])
    at, found = 8 + size, {}
    while at + 8 <= len(content):
        name, size = struct.unpack(">4sI", content[at : at + 8])
        data, k, tick, status = content[at + 8 : at + 8 + size], 0, 0, 0
        while name == b"MTrk" and k < len(data):
            delta, k = variable_length(data, k)
            tick += delta
            if data[k] & 0x80:
                status, k = data[k], k + 1
            if status in (0xFF, 0xF0, 0xF7):
                kind = data[k] if status == 0xFF else None
                n, k = variable_length(data, k + (status == 0xFF))
                if kind == 0x51 and n == 3:
                    found[tick / division] = 60e6 / int.from_bytes(data[k : k + 3], "big")
                k += n
            else:
                k += DATA_BYTES[status >> 4]
        at += 8 + size
    found.setdefault(0.0, 120.0)
    return sorted(found.items())


def read_tempi(spark: SparkSession, path: str) -> DataFrame:
    """(piece_id, tick, bpm): the tempo changes of all .mid files below path, at 480 ticks per beat, as prep.tempo_seconds takes them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.mid*").load(path).select(piece_of(F.col("path")).alias("piece_id"), "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f.piece_id, round(beat * 480), bpm) for f in pdf.itertuples() for beat, bpm in file_tempi(bytes(f.content))]
            yield pd.DataFrame(rows, columns=["piece_id", "tick", "bpm"])

    return files.mapInPandas(parse, "piece_id string, tick long, bpm double")


def tempo_beats(changes: DataFrame, last: DataFrame) -> DataFrame:
    """(piece_id, beat, at): the time in seconds of every beat from 0 to `last` (piece_id, beat), over tempo changes (piece_id, tick, bpm)."""
    beats = last.select("piece_id", F.explode(F.sequence(F.lit(0), F.ceil("beat").cast("int"))).alias("beat"))
    timed = note_seconds(beats.withColumn("tick", F.col("beat").cast("long") * 480), changes)
    return timed.select("piece_id", "beat", F.col("seconds").alias("at"))


def melody_tracks(notes: DataFrame, most: int = 2) -> DataFrame:
    """Notes of a piece's first tracks, which hold the melody and its bridge."""
    return notes.where(F.col("track") < most)


def coded_length(n: int) -> bytes:
    out = bytes([n & 0x7F])
    while n := n >> 7:
        out = bytes([n & 0x7F | 0x80]) + out
    return out


def midi_file(notes: list[tuple[int, int, int, int]], bpm: float = 120.0, division: int = 480) -> bytes:
    """A file of one track from (start, end, pitch, velocity) in ticks."""
    events = sorted([(e, 0x80, p, 0) for _, e, p, _ in notes] + [(s, 0x90, p, v) for s, _, p, v in notes])
    body, now = b"\0\xff\x51\x03" + round(60e6 / bpm).to_bytes(3, "big"), 0
    for tick, status, pitch, velocity in events:
        body += coded_length(tick - now) + bytes([status, pitch, velocity])
        now = tick
    body += b"\0\xff\x2f\0"
    return b"MThd" + struct.pack(">IHHH", 6, 0, 1, division) + b"MTrk" + struct.pack(">I", len(body)) + body


def to_midi(notes: DataFrame, bpm: float = 120.0, per_beat: int = 480) -> DataFrame:
    """(piece_id, content): a MIDI file of each piece's notes (piece_id, onset and duration in beats, pitch), one group per piece."""

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(round(n.onset * per_beat), max(round((n.onset + n.duration) * per_beat), round(n.onset * per_beat) + 1), int(n.pitch), 80) for n in pdf.itertuples()]
        return pd.DataFrame({"piece_id": pdf.piece_id.iloc[:1], "content": [midi_file(rows, bpm, per_beat)]})

    piece = notes.schema["piece_id"].dataType.simpleString()
    return notes.select("piece_id", "onset", "duration", "pitch").groupBy("piece_id").applyInPandas(write, f"piece_id {piece}, content binary")
