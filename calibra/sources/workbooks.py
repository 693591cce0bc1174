"""Cells of spreadsheet workbooks (zipped XML) of any file system that Spark reads, a task for each file."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Namespaces of the format, and the type of a relation to a sheet.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def column_number(cell: str) -> int:
    """0 for A1, 25 for Z9, 26 for AA3."""
    n = 0
    for c in re.match("[A-Z]+", cell)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def said(node: ElementTree.Element) -> str:
    """The text of a string, its runs one after another, without phonetic guides."""
    return "".join(t.text or "" for child in node for t in ([child] if child.tag == f"{MAIN}t" else child.iter(f"{MAIN}t") if child.tag == f"{MAIN}r" else []))


def cells(content: bytes) -> Iterator[tuple[str, int, int, str | None]]:
    """(sheet, row, column, value) of all cells with a value, both numbers from 0, sheets in their order.
    Sheets are read as streams; only shared strings are held."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = [said(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
        target = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
            path = target[sheet.get(RELATION)]
            row = -1
            with book.open(path.lstrip("/") if path.startswith("/") else f"xl/{path}") as file:
                for event, node in ElementTree.iterparse(file, ("start", "end")):
                    if event == "start" and node.tag == f"{MAIN}row":
                        row, column = int(node.get("r", row + 2)) - 1, -1
                    elif event == "end" and node.tag == f"{MAIN}c":
                        column = column_number(node.get("r")) if node.get("r") else column + 1
                        kind, value, inline = node.get("t", "n"), node.find(f"{MAIN}v"), node.find(f"{MAIN}is")
                        text = said(inline) if inline is not None else None if value is None else value.text or ""
                        if text is not None:
                            yield sheet.get("name"), row, column, shared[int(text)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}[text] if kind == "b" else text
                    elif event == "end" and node.tag == f"{MAIN}row":
                        node.clear()


def read_workbooks(spark: SparkSession, path: str, sheets: list[str] | None = None) -> DataFrame:
    """Rows (file, sheet, row, column, value) of the cells below each sheet's first row, which names the
    columns: row from 0, value as text, empty cells left out, as are cells under no name. A file that is
    no workbook is fatal."""
    files = spark.read.format("binaryFile").load(path)

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                header: dict[tuple[str, int], str] = {}
                out: list[tuple] = []
                first: dict[str, int] = {}
                for sheet, row, column, value in cells(content):
                    if sheets is not None and sheet not in sheets:
                        continue
                    if row == first.setdefault(sheet, row):
                        header[sheet, column] = value.strip()
                    elif header.get((sheet, column)) and value != "":
                        out.append((name, sheet, row - first[sheet] - 1, header[sheet, column], value))
                    if len(out) >= 10_000:
                        yield listed(out)
                        out = []
                yield listed(out)

    def listed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [("file", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("column", pa.string()), ("value", pa.string())]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], [n for n, _ in kinds])

    found = files.select("path", "content").mapInArrow(run, "file string, sheet string, row int, column string, value string")
    return found.withColumn("file", F.regexp_extract("file", r"([^/]*)$", 1))


def as_table(cells: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (file, sheet, row and the named columns) of cells; a cell that is not there is null."""
    named = [F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns]
    return cells.groupBy("file", "sheet", "row").agg(*named)
