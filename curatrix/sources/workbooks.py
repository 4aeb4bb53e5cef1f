"""Sheets of Office Open XML workbooks as tables of text, read and written by tasks.

A sheet holds at most ROWS rows by the format, so a workbook is a bounded piece of work: many workbooks are read by many
tasks, rows of one are streamed out of its archive, and a table is written as one workbook for every ROWS rows."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from itertools import chain
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.operators import numbering
from curatrix.session import cut
from curatrix.sources import sharing, stores

# Rows of a sheet without its header, namespaces and types of the format.
ROWS = 1_048_575
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/package/2006/relationships"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
TYPES = "application/vnd.openxmlformats-officedocument.spreadsheetml"
BATCH = 2_000
_NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
_ESCAPED = re.compile("_x([0-9A-Fa-f]{4})_")


def column_name(i: int) -> str:
    """The letters of a column from 0."""
    out = ""
    while i >= 0:
        i, letter = divmod(i, 26)
        out, i = chr(65 + letter) + out, i - 1
    return out


def column_index(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _text(node: ET.Element) -> str:
    """The runs of a string, without phonetic ones."""
    runs = [t.text or "" for child in node for t in ([child] if child.tag == f"{MAIN}t" else child.findall(f"{MAIN}t") if child.tag == f"{MAIN}r" else [])]
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), "".join(runs))


def _sheet(archive: zipfile.ZipFile, name: str | None) -> str:
    """The path of a sheet by name, the first without one."""
    sheets = ET.fromstring(archive.read("xl/workbook.xml")).findall(f"{MAIN}sheets/{MAIN}sheet")
    chosen = next((s for s in sheets if name in (None, s.get("name"))), None)
    if chosen is None:
        raise ValueError(f"no sheet {name!r}")
    links = {r.get("Id"): r.get("Target") for r in ET.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    return posixpath.normpath(posixpath.join("/xl", links[chosen.get(LINK)])).lstrip("/")


def sheet_rows(data: bytes, sheet: str | None = None) -> Iterator[list[str]]:
    """Rows of a sheet in order as lists of texts; cells and rows that the file leaves out are empty."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        strings: list[str] = []
        if "xl/sharedStrings.xml" in archive.namelist():
            for _, node in ET.iterparse(archive.open("xl/sharedStrings.xml")):
                if node.tag == f"{MAIN}si":
                    strings.append(_text(node))
                    node.clear()
        expected = 1
        for _, node in ET.iterparse(archive.open(_sheet(archive, sheet))):
            if node.tag != f"{MAIN}row":
                continue
            number = int(node.get("r") or expected)
            for _ in range(number - expected):
                yield []
            expected, row = number + 1, []
            for cell in node.iter(f"{MAIN}c"):
                at = column_index(cell.get("r")) if cell.get("r") else len(row)
                row += [""] * (at + 1 - len(row))
                kind, value = cell.get("t"), cell.findtext(f"{MAIN}v") or ""
                inline = cell.find(f"{MAIN}is")
                row[at] = strings[int(value)] if kind == "s" and value else _text(inline) if inline is not None else {"1": "True", "0": "False"}.get(value, value) if kind == "b" else value
            yield row
            node.clear()


def _headers(sheet: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [next(sheet_rows(x.as_py(), sheet), []) for x in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(heads, pa.list_(pa.string()))], names=["path", "head"])

    return run


def _tables(sheet: str | None, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = sheet_rows(content.as_py(), sheet)
                head = next(rows, [])
                place = [head.index(n) if n in head else -1 for n in names]
                kept: list[tuple[int, list[str]]] = []

                def made(kept, path=path, place=place):
                    cells = [pa.array([r[p] if 0 <= p < len(r) else "" for _, r in kept], pa.string()) for p in place]
                    return pa.RecordBatch.from_arrays([pa.array([path] * len(kept), pa.string()), pa.array([i for i, _ in kept], pa.int64()), *cells], names=["_path", "_row", *(f"c{i}" for i in range(len(place)))])

                for i, row in enumerate(rows):
                    if any(row):
                        kept.append((i, row))
                    if len(kept) == BATCH:
                        yield made(kept)
                        kept = []
                yield made(kept)

    return run


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None, dropped: tuple[str, ...] = ("file_title",), ordered: bool = False) -> DataFrame:
    """The rows of one or more workbooks' sheets (the first by default) as text, empty cells as empty strings, without some columns and without empty rows.

    The first row names the columns; of several workbooks the columns are those of all, in order of first appearance
    by path. ordered keeps _path and _row, the place in the sheet. Numbers are texts as the file holds them."""
    found = spark.read.format("binaryFile").load(path).select("path", "content")
    heads = found.mapInArrow(_headers(sheet), "path string, head array<string>").orderBy("path").collect()  # a row for each workbook
    names = list(dict.fromkeys(n for r in heads for n in r.head if n))
    rows = found.mapInArrow(_tables(sheet, names), ", ".join(["_path string, _row long", *(f"c{i} string" for i in range(len(names)))]))
    return rows.select(*(["_path", "_row"] if ordered else []), *[F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n not in dropped])


def workbook(names: list[str], rows: Iterator[list[str | None]]) -> bytes:
    """A workbook of one sheet; strings stand in their cells."""
    out = io.BytesIO()
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'

    def cell(i: int, value: str) -> str:
        value = _NOT_XML.sub(lambda m: f"_x{ord(m[0]):04X}_", _ESCAPED.sub(lambda m: f"_x005F_{m[0][1:]}", value)).replace("\r", "_x000D_")
        return f'<c r="{i}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>' if value else ""

    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{TYPES}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{TYPES}.worksheet+xml"/></Types>')
        archive.writestr("_rels/.rels", f'{head}<Relationships xmlns="{RELATIONS}"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        archive.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{NS}" xmlns:r="{OFFICE}"><sheets><sheet name={quoteattr("Sheet1")} sheetId="1" r:id="rId1"/></sheets></workbook>')
        archive.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{RELATIONS}"><Relationship Id="rId1" Type="{OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with archive.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
            sheet.write(f'{head}<worksheet xmlns="{NS}"><sheetData>'.encode())
            for i, row in enumerate(chain([names], rows), 1):
                cells = "".join(cell(f"{column_name(j)}{i}", v) for j, v in enumerate(row) if v)
                sheet.write(f'<row r="{i}">{cells}</row>'.encode("utf-8", "replace"))
            sheet.write(b"</sheetData></worksheet>")
    return out.getvalue()


def _written(path: str, names: list[str]):
    def run(table: pa.Table) -> pa.Table:
        book = table.column("_book")[0].as_py()
        table = table.sort_by("_at").select(names)
        rows = (list(r.values()) for batch in table.to_batches(max_chunksize=BATCH) for r in batch.to_pylist())
        sharing.put(f"{path}/part-{book:05}.xlsx", workbook(names, rows))
        return pa.table({"book": [book], "rows": [len(table)]}, pa.schema([("book", pa.int64()), ("rows", pa.int64())]))

    return run


def write_workbook(df: DataFrame, path: str, loaded: list[str], *order: str) -> DataFrame:
    """Workbooks part-00000.xlsx and on in a shared folder, one for every ROWS rows in an order of columns (all of them by default), with columns as they were loaded and new ones after them. Gives (book, rows).

    Of an earlier, longer table no part stays: the folder is emptied first. Nulls are empty cells."""
    columns = [c for c in loaded if c in df.columns] + [c for c in df.columns if c not in loaded]
    plain = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    stores.empty(df.sparkSession, path)
    placed = numbering.numbered(plain, *(order or [f"`{c}`" for c in columns])).withColumnRenamed("i", "_at")
    books = placed.withColumn("_book", F.expr(f"_at div {ROWS}"))
    return cut(books.groupBy("_book").applyInArrow(_written(path, columns), "book long, rows long"))
