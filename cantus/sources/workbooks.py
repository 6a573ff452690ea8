"""Sheets of XLSX workbooks: downbeats and chords.

Files come through Spark's own reader of binary files, so that any store that Spark reads will do; a task parses one workbook at a
time and gives its rows on as they are read.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .notes import piece_of

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Rows of a batch that leaves a task.
ROWS = 4096

Cell = tuple[str | None, float | None] | None


def _strings(book: zipfile.ZipFile) -> list[str]:
    """The shared strings: plain or of several runs, without readings."""
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, si in ElementTree.iterparse(f):
            if si.tag == f"{MAIN}si":
                out.append("".join(t.text or "" for e in si if e.tag != f"{MAIN}rPh" for t in e.iter(f"{MAIN}t")))
                si.clear()
    return out


def _sheet_path(book: zipfile.ZipFile, sheet: int) -> str | None:
    """The file of the sheet at a place (from 0) of the workbook's own order; None if there are fewer."""
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{MAIN}sheets")
    if sheets is None or sheet >= len(sheets):
        return None
    wanted = sheets[sheet].get(RELATION)
    for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if r.get("Id") == wanted:
            target = r.get("Target", "")
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return None


def _place(name: str) -> int:
    """A column's number (from 0) of a cell's name: A1 is 0, AB7 is 27."""
    n = 0
    for c in re.match(r"[A-Z]*", name)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _cell(c: ElementTree.Element, strings: list[str]) -> Cell:
    """(text, number) of a cell; a text's number is None. Numbers are written as Python writes them, cells in error and empty ones are None."""
    kind, v = c.get("t", "n"), c.findtext(f"{MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{MAIN}t")), None
    if v is None or kind == "e":
        return None
    if kind == "s":
        return strings[int(v)], None
    if kind == "str":
        return v, None
    if kind == "b":
        return ("True", 1.0) if v == "1" else ("False", 0.0)
    number = float(v)
    return (str(int(v)) if re.fullmatch(r"-?\d+", v) else repr(number)), number


def sheet_rows(content: bytes, sheet: int = 0, columns: int | None = None) -> Iterator[tuple[int, list[Cell]]]:
    """(row number from 1, cells) of a sheet, rows as they are read; with `columns` only the first ones are looked at. Missing cells are None."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        path = _sheet_path(book, sheet)
        if path is None:
            return
        strings = _strings(book)
        with book.open(path) as f:
            last = 0
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{MAIN}row":
                    continue
                cells: list[Cell] = []
                for k, c in enumerate(row.iter(f"{MAIN}c")):
                    at = _place(c.get("r", "")) if c.get("r") else k
                    if columns is not None and at >= columns:
                        break
                    cells += [None] * (at - len(cells)) + [_cell(c, strings)]
                last = int(row.get("r", last + 1))
                yield last, cells
                row.clear()


def read_cells(spark: SparkSession, path: str, sheet: int = 0, columns: int | None = None) -> DataFrame:
    """(path, row, cells) of a sheet of every workbook under path: cells is an array of (text, number), a text's number and what is empty are null.

    With `columns` only so many are parsed. A file that is no workbook raises; a workbook with fewer sheets has no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    kind = pa.list_(pa.struct([("text", pa.string()), ("number", pa.float64())]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(name: str, rows: list[tuple[int, list[Cell]]]) -> pa.RecordBatch:
            cells = [[None if c is None else {"text": c[0], "number": c[1]} for c in r] for _, r in rows]
            return pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array([n for n, _ in rows], pa.int32()), pa.array(cells, kind)], names=["path", "row", "cells"])

        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content")):
                rows = []
                for r in sheet_rows(content.as_buffer().to_pybytes(), sheet, columns):
                    rows.append(r)
                    if len(rows) == ROWS:
                        yield batch(name, rows)
                        rows = []
                if rows:
                    yield batch(name, rows)

    return files.mapInArrow(parse, "path string, row int, cells array<struct<text:string,number:double>>")


def folder_of(path: Column) -> Column:
    """The name of the folder that a file is in."""
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def _text(k: int) -> Column:
    return F.get(F.col("cells"), F.lit(k))["text"]


def _number(k: int) -> Column:
    return F.get(F.col("cells"), F.lit(k))["number"]


def read_workbook_downbeats(spark: SparkSession, path: str, by_folder: bool = False) -> DataFrame:
    """(piece_id, downbeat) of the first column of each workbook's first sheet, where it is a number or a text that says one. A piece is
    named by its file, or by the file's folder."""
    rows = read_cells(spark, path, 0, 1)
    value = F.coalesce(_number(0), F.trim(_text(0)).try_cast("double"))
    return rows.select((folder_of if by_folder else piece_of)(F.col("path")).alias("piece_id"), value.alias("downbeat")).where("downbeat is not null")


def read_workbook_chords(spark: SparkSession, path: str, by_folder: bool = True) -> DataFrame:
    """(piece_id, row, onset, end, key, degree, quality, inversion, chord) of the first seven columns of each workbook's first sheet.

    Rows whose first cell is no number (headers among them) and sheets of fewer than seven columns have no chords. Texts that are missing are empty, a degree that is a
    whole number is written as one, a missing inversion is 0; an end that is no number is null.
    """
    rows = read_cells(spark, path, 0, 7)
    wide = rows.groupBy("path").agg(F.max(F.size("cells")).alias("width")).where("width >= 7").select("path")
    text = lambda k: F.coalesce(_text(k), F.lit(""))
    degree = F.when(_number(3) == F.floor(_number(3)), F.floor(_number(3)).cast("string")).otherwise(text(3))
    number = lambda k: F.coalesce(_number(k), F.trim(_text(k)).try_cast("double"))
    out = rows.join(wide, "path", "left_semi").where(_number(0).isNotNull())
    return out.select((folder_of if by_folder else piece_of)(F.col("path")).alias("piece_id"), "row", _number(0).alias("onset"), number(1).alias("end"), text(2).alias("key"), degree.alias("degree"), text(4).alias("quality"), F.coalesce(number(5).cast("int"), F.lit(0)).alias("inversion"), text(6).alias("chord"))
