"""Spreadsheet workbooks (.xlsx) as cell grids: a Python data source with a partition a sheet.

A workbook is a zip of XML parts. The driver reads the list of sheets alone; each task streams its own sheet's
part cell by cell, so that no task holds a sheet. Paths are those that pyarrow's file systems
open (local, hdfs, s3, gs)."""

from __future__ import annotations

import posixpath
import re
import zipfile
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "furrow_workbook"
SCHEMA = "sheet string, row int, col int, value string"


class SheetPart(InputPartition):
    def __init__(self, path: str, sheet: str, part: str):
        self.path, self.sheet, self.part = path, sheet, part


def _opened(path: str):
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if re.match(r"^\w+:", path) else (fs.LocalFileSystem(), path)
    return system.open_input_file(at)


def _tag(element) -> str:
    return element.tag.rpartition("}")[2]


def sheets(path: str) -> list[tuple[str, str]]:
    """(name, part) of each worksheet, in the workbook's order."""
    with _opened(path) as f, zipfile.ZipFile(f) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")) if r.get("Type", "").endswith("/worksheet")}
        found = [(s.get("name"), links.get(next((v for k, v in s.attrib.items() if k.endswith("}id")), ""))) for s in book.iter() if _tag(s) == "sheet"]
    return [(name, target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")) for name, target in found if target]


def _text(element) -> str:
    """The shown text of a string item: its runs, without reading aids."""
    if _tag(element) == "rPh":
        return ""
    own = element.text or "" if _tag(element) == "t" else ""
    return own + "".join(map(_text, element))


def _strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    out = []
    with z.open("xl/sharedStrings.xml") as f:
        for _, e in ElementTree.iterparse(f):
            if _tag(e) == "si":
                out.append(_text(e))
                e.clear()
    return out


def _plain(number: str) -> str:
    """A stored number without an exponent and without needless zeros."""
    try:
        d = Decimal(repr(float(number)))
    except (ValueError, InvalidOperation):
        return number
    text = format(d, "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def cells(path: str, part: str) -> Iterator[tuple[int, int, str]]:
    """(row, col, value) from 0 of a sheet's cells that have a value; errors have none."""
    with _opened(path) as f, zipfile.ZipFile(f) as z:
        strings = _strings(z)
        row, col = -1, -1
        with z.open(part) as sheet:
            for event, e in ElementTree.iterparse(sheet, ("start", "end")):
                tag = _tag(e)
                if event == "start":
                    if tag == "row":
                        row, col = int(e.get("r", row + 2)) - 1, -1
                    continue
                if tag == "c":
                    m = re.match(r"([A-Z]+)(\d+)", e.get("r", ""))
                    col = col + 1
                    if m:
                        col = 0
                        for letter in m[1]:
                            col = 26 * col + ord(letter) - 64
                        col -= 1
                    kind, held = e.get("t", "n"), next((x for x in e if _tag(x) == "v"), None)
                    value = None if held is None else held.text
                    if kind == "s" and value is not None:
                        value = strings[int(value)]
                    elif kind == "inlineStr":
                        value = "".join(map(_text, e))
                    elif kind == "b" and value is not None:
                        value = "True" if value.strip() == "1" else "False"
                    elif kind == "e":
                        value = None
                    elif kind == "n" and value is not None:
                        value = _plain(value)
                    if value is not None:
                        yield row, col, value
                elif tag == "row":
                    e.clear()


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[SheetPart]:
        return [SheetPart(self.path, name, part) for name, part in sheets(self.path)]

    def read(self, partition: SheetPart) -> Iterator[tuple[str, int, int, str]]:
        for row, col, value in cells(partition.path, partition.part):
            yield partition.sheet, row, col, value


class Workbook(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options["path"])


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """Cells of every sheet of a workbook: sheet, row, col, value (text), the form that ``sheets.build_panel`` takes."""
    spark.dataSource.register(Workbook)
    return spark.read.format(NAME).load(path)
