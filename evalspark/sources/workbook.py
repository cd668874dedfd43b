"""Sheets of xlsx workbooks, read with the standard library: a workbook is a zip of XML parts."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import batched
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


#: Rows of a sheet that leave the parser together.
ROWS = 10_000


def column_place(ref: str) -> int:
    """Place of a cell reference's column: A1 -> 0, AB7 -> 27."""
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def sheet_names(raw: bytes) -> dict[str, str]:
    """Sheet name -> part of the zip."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    part = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
    return {s.get("name"): part(links[s.get(_LINK)]) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")}


def _text(e: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in e.iter(f"{_MAIN}t"))


def _elements(part, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of a tag as the part is read; each is forgotten when the next one comes."""
    walk = ElementTree.iterparse(part, events=("start", "end"))
    _, root = next(walk)
    holder = root
    for event, e in walk:
        if event == "start" and e.tag == f"{_MAIN}sheetData":
            holder = e
        elif event == "end" and e.tag == f"{_MAIN}{tag}":
            yield e
            holder.clear()


def sheet_rows(raw: bytes, sheet: str, wanted: Callable[[list[str | None]], set[int]] | None = None) -> Iterator[list[str | None]]:
    """Cells of a sheet as text, row by row as the part is read; a sheet that is not there is an error that lists those
    that are. ``wanted`` picks places from the first row; cells at other places are not made."""
    names = sheet_names(raw)
    if sheet not in names:
        raise ValueError(f"no sheet {sheet!r}; the workbook has {sorted(names)}")
    z = zipfile.ZipFile(io.BytesIO(raw))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        with z.open("xl/sharedStrings.xml") as part:
            shared = [_text(e) for e in _elements(part, "si")]
    places = None
    with z.open(names[sheet]) as part:
        for row in _elements(part, "row"):
            cells: dict[int, str | None] = {}
            for k, c in enumerate(row.iter(f"{_MAIN}c")):
                at = column_place(c.get("r")) if c.get("r") else k
                if places is not None and at not in places:
                    continue
                value, kind = c.find(f"{_MAIN}v"), c.get("t")
                cells[at] = _text(c) if kind == "inlineStr" else None if value is None else shared[int(value.text)] if kind == "s" else {"1": "True", "0": "False"}[value.text] if kind == "b" else value.text
            out = [cells.get(i) for i in range(max(cells, default=-1) + 1)]
            yield out
            if wanted is not None and places is None:
                places = wanted(out)


def read_sheet(spark: SparkSession, path: str, sheet: str, columns: list[str] | None = None) -> DataFrame:
    """A sheet as a table of text columns named by its first row, with ``source_row`` (2 is the first row of data).

    An executor unzips the sheet's part as a stream and parses it row by row, so that neither the sheet nor its XML is
    ever whole in memory (the zipped file and its shared strings are). A zip has no splits: one task reads a workbook.
    Of a sheet with ``columns`` only their cells are made.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raw in pdf["content"]:
                at = 0
                for rows in batched(sheet_rows(bytes(raw), sheet, pick), ROWS):
                    yield pd.DataFrame({"source_row": range(at + 1, at + 1 + len(rows)), "cells": rows})
                    at += len(rows)

    pick = None if columns is None else lambda head: {i for i, x in enumerate(head) if x in columns}
    cells = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "source_row long, cells array<string>")
    head = cells.where("source_row = 1").first()
    if head is None:
        raise ValueError(f"{path}: sheet {sheet!r} is empty")
    names = column_names(head["cells"], f"{path}: sheet {sheet!r}")
    if missing := [c for c in columns or [] if c not in names]:
        raise ValueError(f"{path}: sheet {sheet!r} lacks the columns {missing}")
    return cells.where("source_row > 1").select("source_row", *[F.get("cells", F.lit(names.index(n))).alias(n) for n in columns or names])


def column_names(head: list[str | None], where: str) -> list[str]:
    """Names of a sheet's columns by its first row; a repeated name is an error."""
    names = [str(x) if x is not None else f"column_{i}" for i, x in enumerate(head)]
    if len(set(names)) < len(names):
        raise ValueError(f"{where} repeats a column name")
    return names


def read_workbooks(spark: SparkSession, path: str, sheets: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Sheets of all workbooks under ``path`` (a file, folder or pattern): file, sheet, source_row and record, a map of the
    first row's names to the row's cells as text.

    Every sheet of a workbook is a scan of its own, so the sheets of one file are parsed by several tasks and nothing is
    shuffled; the driver learns only the greatest number of sheets. Files come through Spark's reader, from any file system
    that it knows. ``sheets`` are read and no others, a file without one of them is an error; without ``sheets`` all are
    read. Of ``columns`` alone cells are made; a sheet that lacks one has no such key. Cells right of the first row's last
    one are left out, absent cells are null; an empty sheet or one with a first row alone gives no rows.
    """

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"n": [len(sheet_names(bytes(raw))) for raw in pdf["content"]]}, dtype="int64")

    def scan(chosen: str | int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for file, raw in zip(pdf["path"], map(bytes, pdf["content"]), strict=True):
                    there = list(sheet_names(raw))
                    if isinstance(chosen, int) and chosen >= len(there):
                        continue
                    sheet = there[chosen] if isinstance(chosen, int) else chosen
                    rows = sheet_rows(raw, sheet, pick)
                    names = column_names(next(rows, []), f"{file}: sheet {sheet!r}")
                    kept = [(i, n) for i, n in enumerate(names) if columns is None or n in columns]
                    at = 2
                    for some in batched(rows, ROWS):
                        records = [{n: r[i] if i < len(r) else None for i, n in kept} for r in some]
                        yield pd.DataFrame({"file": file, "sheet": sheet, "source_row": range(at, at + len(some)), "record": records})
                        at += len(some)

        return run

    pick = None if columns is None else lambda head: {i for i, x in enumerate(head) if x in columns}
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    scans: list[str | int] = list(sheets) if sheets else []
    if sheets is None:
        most = files.select("content").mapInPandas(listed, "n long").agg(F.max("n")).first()[0]
        scans = list(range(most or 1))
    if not scans:
        raise ValueError("sheets is empty; leave it out to read all")
    parts = [files.mapInPandas(scan(s), "file string, sheet string, source_row long, record map<string,string>") for s in scans]
    return reduce(DataFrame.unionByName, parts)
