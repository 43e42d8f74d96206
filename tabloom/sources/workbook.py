"""Workbooks (xlsx, xlsm) as a Spark data source: ``spark.read.format("workbook")``.

One partition per sheet; a sheet is parsed once, as a stream, in the task that
reads it. An archive is looked over on the driver before any partition is
planned: too many members, too large or too densely packed ones and document
type definitions are refused. The older binary format isn't supported.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# What an archive may hold.
LIMITS = {"members": 2000, "uncompressed_bytes": 2 << 30, "compression_ratio": 200, "member_bytes": 1 << 30, "shared_strings_bytes": 512 << 20, "merges_per_sheet": 100_000}

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_REF = re.compile(r"([A-Z]+)([0-9]+)")


class RefusedArchive(ValueError):
    """The workbook isn't safe to open."""


@dataclass(frozen=True)
class Sheet:
    name: str
    member: str
    hidden: bool
    order: int


def preflight(path: str, limits: dict[str, int] = LIMITS) -> None:
    """Refuses an archive that could exhaust a task before anything of it is parsed."""
    with zipfile.ZipFile(path) as z:
        members = z.infolist()
        total = sum(m.file_size for m in members)
        packed = sum(m.compress_size for m in members) or 1
        tests = (
            (len(members) > limits["members"], "members"),
            (total > limits["uncompressed_bytes"], "uncompressed_bytes"),
            (total / packed > limits["compression_ratio"], "compression_ratio"),
            (any(m.file_size > limits["member_bytes"] for m in members), "member_bytes"),
            (any(m.filename.endswith("sharedStrings.xml") and m.file_size > limits["shared_strings_bytes"] for m in members), "shared_strings_bytes"),
        )
        for bad, name in tests:
            if bad:
                raise RefusedArchive(f"{path}: more than {limits[name]} {name}")
        for m in members:
            if m.filename.endswith((".xml", ".rels")):
                with z.open(m) as f:
                    if b"<!DOCTYPE" in f.read(4096).upper():
                        raise RefusedArchive(f"{path}: {m.filename} has a document type definition")


def sheets(path: str) -> list[Sheet]:
    """Sheets in the workbook's order; charts have no cells and are left out."""
    with zipfile.ZipFile(path) as z:
        rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        targets = {r.get("Id"): (r.get("Target", ""), r.get("Type", "")) for r in rels}
        book = ET.fromstring(z.read("xl/workbook.xml"))
        out = []
        for k, s in enumerate(book.iter(f"{_MAIN}sheet")):
            target, kind = targets.get(s.get(_REL), ("", ""))
            if kind.endswith("/worksheet"):
                member = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
                out.append(Sheet(s.get("name", ""), member, s.get("state", "visible") != "visible", k))
        return out


def _column(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _position(ref: str) -> tuple[int, int]:
    m = _REF.fullmatch(ref)
    return int(m[2]) - 1, _column(m[1])


def merges(path: str, sheet: Sheet, limits: dict[str, int] = LIMITS) -> list[tuple[int, int, int, int]]:
    """Merged ranges (r0, c0, r1, c1), inclusive, from 0."""
    out = []
    with zipfile.ZipFile(path) as z, z.open(sheet.member) as f:
        for _, e in ET.iterparse(f):
            if e.tag == f"{_MAIN}mergeCell":
                a, _, b = e.get("ref", "").partition(":")
                out.append((*_position(a), *_position(b or a)))
                if len(out) > limits["merges_per_sheet"]:
                    raise RefusedArchive(f"{path}: too many merged ranges")
            elif e.tag == f"{_MAIN}row":
                e.clear()
    return out


def _shared(z: zipfile.ZipFile) -> list[str]:
    try:
        f = z.open("xl/sharedStrings.xml")
    except KeyError:
        return []
    out = []
    with f:
        for _, e in ET.iterparse(f):
            if e.tag == f"{_MAIN}si":
                out.append("".join(t.text or "" for t in e.iter(f"{_MAIN}t")))
                e.clear()
    return out


def text_of(value: str | None) -> str | None:
    """A cell as text: blank is null, an integral number has no fraction."""
    if value is None or not value.strip():
        return None
    value = value.strip()
    if re.fullmatch(r"-?[0-9.]+(?:[eE][+-]?[0-9]+)?", value):
        try:
            number = float(value)
        except ValueError:
            return value
        if number.is_integer() and abs(number) < 1e15 and ("." in value or "e" in value.lower()):
            return str(int(number))
    return value


def rows(path: str, sheet: Sheet) -> Iterator[tuple[int, list[str | None]]]:
    """Rows of a sheet as they stream; null cells at a row's end are left out."""
    with zipfile.ZipFile(path) as z:
        shared = _shared(z)
        with z.open(sheet.member) as f:
            at = -1
            for _, e in ET.iterparse(f):
                if e.tag != f"{_MAIN}row":
                    continue
                at = int(e.get("r")) - 1 if e.get("r") else at + 1
                cells: list[str | None] = []
                for k, c in enumerate(e.iter(f"{_MAIN}c")):
                    column = _position(c.get("r"))[1] if c.get("r") else k
                    v, kind = c.find(f"{_MAIN}v"), c.get("t")
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    elif v is None:
                        text = None
                    elif kind == "s":
                        text = shared[int(v.text)]
                    elif kind == "b":
                        text = "TRUE" if v.text == "1" else "FALSE"
                    else:
                        text = v.text if kind == "str" else text_of(v.text)
                    text = text.strip() if text and text.strip() else None
                    if text is not None:
                        cells.extend([None] * (column + 1 - len(cells)))
                        cells[column] = text
                e.clear()
                yield at, cells


@dataclass
class SheetPartition(InputPartition):
    path: str
    sheet: Sheet

    def __init__(self, path: str, sheet: Sheet):
        super().__init__((path, sheet.order))
        self.path, self.sheet = path, sheet


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.only = options["path"], options.get("sheet")

    def partitions(self) -> list[SheetPartition]:
        preflight(self.path)
        return [SheetPartition(self.path, s) for s in sheets(self.path) if self.only in (None, s.name)]

    def read(self, partition: SheetPartition) -> Iterator[tuple]:
        for at, cells in rows(partition.path, partition.sheet):
            yield partition.sheet.name, at, cells


class WorkbookSource(DataSource):
    """(sheet, _row, cells) of a workbook; option ``sheet`` for one of them."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "sheet string, _row int, cells array<string>"

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(dict(self.options))


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    from tabloom.session import ship

    ship(spark)
    spark.dataSource.register(WorkbookSource)
    reader = spark.read.format("workbook").option("path", path)
    return (reader.option("sheet", sheet) if sheet is not None else reader).load()
