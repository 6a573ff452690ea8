"""NPY and NPZ files as a Spark data source ("numpy"), by byte ranges.

    spark.dataSource.register(NumpySource)
    spark.read.format("numpy").load("/shared/embeddings")            # row, value; or row and a column for each array of NPZ files
    df.write.format("numpy").mode("overwrite").save("/shared/out")   # part-*.npy; option("kind", "npz"): part-*.npz

A file's first axis is its rows. Plain arrays and stored members of archives are split into ranges of bytes, one task each;
deflated members are read in order, a stretch at a time, by one task for each file. Paths must be mounted on every executor.
"""

from __future__ import annotations

import glob
import os
import shutil
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, BooleanType, ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

#: Bytes of a range, and of a batch within one.
SPLIT, BATCH = 64 << 20, 4 << 20
KINDS: dict[str, DataType] = {"bool": BooleanType(), "int8": ByteType(), "int16": ShortType(), "int32": IntegerType(), "int64": LongType(), "float32": FloatType(), "float64": DoubleType(), "uint8": ShortType(), "uint16": IntegerType(), "uint32": LongType(), "float16": FloatType()}
WIDER = {"uint8": "int16", "uint16": "int32", "uint32": "int64", "float16": "float32"}


@dataclass(frozen=True)
class Array:
    """Where an array's bytes begin in a file, and what they mean. offset -1: deflated."""

    name: str
    path: str
    shape: tuple[int, ...]
    dtype: str
    fortran: bool
    offset: int

    @property
    def rows(self) -> int:
        return self.shape[0]

    @property
    def row_bytes(self) -> int:
        return max(1, int(np.prod(self.shape[1:], dtype=np.int64)) * np.dtype(self.dtype).itemsize)


def _header(f, name: str, path: str, offset: int) -> Array:
    """Reads an array's header from f; offset is where f stands in the file, -1 if that means nothing."""
    version = np.lib.format.read_magic(f)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if dtype.hasobject or not (dtype.name in KINDS or dtype.kind in "US"):
        raise ValueError(f"{path}: arrays of {dtype} can't be read")
    return Array(name, path, shape or (1,), dtype.str, fortran and len(shape) > 1, offset if offset < 0 else offset + f.tell())


def arrays_of(path: str) -> list[Array]:
    """The arrays of a .npy or .npz file, by headers alone."""
    if path.endswith(".npy"):
        with open(path, "rb") as f:
            return [_header(f, "value", path, 0)]
    out = []
    with zipfile.ZipFile(path) as z:
        for m in z.infolist():
            offset = -1
            if m.compress_type == zipfile.ZIP_STORED:
                with open(path, "rb") as f:  # the local header has lengths of its own
                    f.seek(m.header_offset + 26)
                    offset = m.header_offset + 30 + sum(struct.unpack("<HH", f.read(4)))
            with z.open(m) as f:
                out.append(_header(f, m.filename.removesuffix(".npy"), path, offset))
    if len({a.rows for a in out}) > 1:
        raise ValueError(f"{path}: arrays of different lengths: {[(a.name, a.rows) for a in out]}")
    return out


def _type(a: Array) -> DataType:
    dtype = np.dtype(a.dtype)
    kind: DataType = StringType() if dtype.kind in "US" else KINDS[dtype.name]
    for _ in a.shape[1:]:
        kind = ArrayType(kind, False)
    return kind


def _column(values: np.ndarray) -> pa.Array:
    """An Arrow column of rows of any number of axes."""
    dtype = values.dtype.newbyteorder("=")
    flat = np.ascontiguousarray(values).reshape(-1).astype(WIDER.get(dtype.name, dtype), copy=False)
    out = pa.array([x.decode() if isinstance(x, bytes) else str(x) for x in flat.tolist()], pa.string()) if dtype.kind in "US" else pa.array(flat)
    for k in range(values.ndim - 1, 0, -1):
        n = int(np.prod(values.shape[:k], dtype=np.int64))
        out = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int64) * values.shape[k], pa.int32()), out)
    return out


@dataclass
class Rows(InputPartition):
    """Rows [first, first + n) of a file, which are rows `at` and on of all files."""

    path: str
    first: int
    n: int
    at: int


class NumpyReader(DataSourceReader):
    def __init__(self, files: list[str], schema: StructType, split: int):
        self.files, self.schema, self.split = files, schema, split

    def partitions(self) -> list[Rows]:
        out, at = [], 0
        for path in self.files:
            found = arrays_of(path)
            rows = found[0].rows if found else 0
            step = rows if any(a.offset < 0 for a in found) else max(1, self.split // sum(a.row_bytes for a in found))
            out += [Rows(path, i, min(step, rows - i), at + i) for i in range(0, rows, max(step, 1))]
            at += rows
        return out or [Rows("", 0, 0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if not part.n:
            return
        wanted = [f.name for f in self.schema.fields if f.name != "row"]
        found = {a.name: a for a in arrays_of(part.path)}
        chosen = [found[n] for n in wanted if n in found]
        if len(chosen) < len(wanted):
            raise ValueError(f"{part.path} has no array {sorted(set(wanted) - set(found))}")
        step = max(1, BATCH // sum((a.row_bytes for a in chosen), 1))
        sources = [self._slices(a, part, step) for a in chosen]
        for i in range(0, part.n, step):
            n = min(step, part.n - i)
            columns = {"row": pa.array(np.arange(part.at + i, part.at + i + n))} | {a.name: _column(next(s)) for a, s in zip(chosen, sources)}
            names = [f.name for f in self.schema.fields]
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    @staticmethod
    def _slices(a: Array, part: Rows, step: int) -> Iterator[np.ndarray]:
        dtype, shape = np.dtype(a.dtype), a.shape[1:]
        if a.offset >= 0:
            if not a.row_bytes or 0 in a.shape:
                whole = np.zeros(a.shape, dtype)
            else:
                whole = np.memmap(a.path, dtype, "r", a.offset, a.shape, "F" if a.fortran else "C")
            for i in range(0, part.n, step):
                yield np.asarray(whole[part.first + i : part.first + min(i + step, part.n)])
            return
        if a.fortran:
            raise ValueError(f"{a.path}: {a.name} is deflated in Fortran order")
        with zipfile.ZipFile(a.path) as z, z.open(f"{a.name}.npy") as f:
            _header(f, a.name, a.path, -1)
            for i in range(0, part.n, step):
                n = min(step, part.n - i)
                yield np.frombuffer(f.read(n * int(np.prod(shape, dtype=np.int64)) * dtype.itemsize), dtype).reshape(n, *shape)


@dataclass
class Part(WriterCommitMessage):
    """A file that a task has written, and where it goes."""

    written: str | None
    name: str | None


def _rows(column: pa.Array, field: StructField) -> np.ndarray:
    """Rows of a column as one array; lists must have one length each axis."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError(f"{field.name}: nulls can't be written")
    shape, kind = [len(column)], field.dataType
    while isinstance(kind, ArrayType):
        n = np.diff(column.offsets.to_numpy())
        if len(n) and n.min() != n.max():
            raise ValueError(f"{field.name}: rows of {n.min()} to {n.max()} values make no array")
        shape.append(int(n[0]) if len(n) else 0)
        column, kind = column.flatten(), kind.elementType
        if column.null_count:
            raise ValueError(f"{field.name}: nulls can't be written")
    if not any(isinstance(kind, type(k)) for k in KINDS.values()):
        raise ValueError(f"{field.name}: {kind.simpleString()} can't be written")
    return column.to_numpy(zero_copy_only=False).reshape(shape)


class NumpyWriter(DataSourceArrowWriter):
    """Every task writes its rows, batch by batch, to a folder that commit() moves into place and abort() deletes."""

    def __init__(self, path: str, schema: StructType, overwrite: bool, kind: str):
        self.path, self.overwrite, self.kind = path, overwrite, kind
        self.fields = [f for f in schema.fields if f.name != "row"]
        if kind == "npy" and len(self.fields) != 1:
            raise ValueError(f"a .npy file holds one array, not {[f.name for f in self.fields]}; write npz")
        self.own = os.path.join(path, f"_temporary-{uuid.uuid4().hex}")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        task = TaskContext.get()
        base = os.path.join(self.own, f"{task.partitionId():05d}-{task.taskAttemptId()}")
        os.makedirs(base, exist_ok=True)
        n, shapes, types, files = 0, {}, {}, {f.name: open(os.path.join(base, f"{k}.raw"), "wb") for k, f in enumerate(self.fields)}
        try:
            for b in batches:
                for f in self.fields:
                    rows = _rows(b.column(b.schema.names.index(f.name)), f)
                    if b.num_rows and shapes.setdefault(f.name, rows.shape[1:]) != rows.shape[1:]:
                        raise ValueError(f"{f.name}: rows of {shapes[f.name]} and of {rows.shape[1:]} values make no array")
                    types[f.name] = rows.dtype
                    files[f.name].write(np.ascontiguousarray(rows).tobytes())
                n += b.num_rows
        finally:
            for f in files.values():
                f.close()
        if not n:
            return Part(None, None)
        out = os.path.join(base, f"part.{self.kind}")
        headers = {f.name: {"descr": types[f.name].str, "fortran_order": False, "shape": (n, *shapes[f.name])} for f in self.fields}
        if self.kind == "npy":
            with open(out, "wb") as to:
                np.lib.format.write_array_header_2_0(to, headers[self.fields[0].name])
                with open(os.path.join(base, "0.raw"), "rb") as raw:
                    shutil.copyfileobj(raw, to, BATCH)
        else:
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for k, f in enumerate(self.fields):
                    with z.open(f"{f.name}.npy", "w", force_zip64=True) as to, open(os.path.join(base, f"{k}.raw"), "rb") as raw:
                        np.lib.format.write_array_header_2_0(to, headers[f.name])
                        shutil.copyfileobj(raw, to, BATCH)
        return Part(out, f"part-{task.partitionId():05d}.{self.kind}")

    def commit(self, messages: list[Part | None]) -> None:
        os.makedirs(self.path, exist_ok=True)
        before = [f for ending in ("npy", "npz") for f in glob.glob(os.path.join(glob.escape(self.path), f"part-*.{ending}"))]
        if self.overwrite:
            for f in before:
                os.remove(f)
        first = 0 if self.overwrite else len(before)
        for k, m in enumerate(sorted((m for m in messages if m and m.written), key=lambda m: m.name)):
            os.replace(m.written, os.path.join(self.path, f"part-{first + k:05d}.{self.kind}"))
        shutil.rmtree(self.own, ignore_errors=True)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.own, ignore_errors=True)
        if os.path.isdir(self.path) and not os.listdir(self.path):
            os.rmdir(self.path)


class NumpySource(DataSource):
    """Options: split (bytes of a task's range), kind (of what is written: npy or npz). Files of a folder are one table, in order of their names."""

    @classmethod
    def name(cls) -> str:
        return "numpy"

    @property
    def path(self) -> str:
        return self.options["path"].removeprefix("file://")

    def files(self) -> list[str]:
        if os.path.isdir(self.path):
            return sorted(f for ending in ("npy", "npz") for f in glob.glob(os.path.join(glob.escape(self.path), f"*.{ending}")))
        found = sorted(glob.glob(self.path)) or [self.path]
        return [f for f in found if f.endswith((".npy", ".npz"))]

    def schema(self) -> StructType:
        files = self.files()
        if not files:
            raise ValueError(f"{self.path}: no .npy or .npz file, and no schema is given")
        return StructType([StructField("row", LongType(), False), *(StructField(a.name, _type(a), False) for a in arrays_of(files[0]))])

    def reader(self, schema: StructType) -> NumpyReader:
        return NumpyReader(self.files(), schema, int(self.options.get("split", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> NumpyWriter:
        return NumpyWriter(self.path, schema, overwrite, self.options.get("kind", "npy"))


def read_numpy(spark: SparkSession, path: str, columns: list[str] | None = None, split: int = SPLIT) -> DataFrame:
    """The rows of the .npy or .npz files of a folder or pattern: row and value, or row and a column for each array. With `columns` only those
    arrays are read."""
    spark.dataSource.register(NumpySource)
    reader = spark.read.format("numpy").option("split", str(split))
    if columns is None:
        return reader.load(path)
    whole = NumpySource({"path": path}).schema()
    return reader.schema(StructType([f for f in whole.fields if f.name == "row" or f.name in columns])).load(path)


def write_numpy(table: DataFrame, path: str, kind: str = "npy", mode: str = "overwrite") -> None:
    """Writes columns of numbers, or of arrays of one length, as part files; a column `row` is left out (rows keep the order of partitions)."""
    table.sparkSession.dataSource.register(NumpySource)
    table.write.format("numpy").option("kind", kind).mode(mode).save(path)
