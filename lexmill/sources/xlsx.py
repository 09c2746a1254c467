"""Spreadsheets: the first sheet of a workbook as a table, and small tables as a workbook.

A workbook is one compressed file that is read and written whole, so it holds lists and reports, not
corpora: tables of more than MOST_ROWS rows are refused. Cells are read as text; schemas are the
caller's.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lexmill.runtime import file_system

MOST_ROWS = 100_000
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
# The parts every workbook has.
_TYPES = (
    '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{sheets}</Types>'
)
_SHEET_TYPE = '<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
_RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{items}</Relationships>'
_REL = '<Relationship Id="rId{n}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{kind}" Target="{target}"/>'
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _column(name: str) -> int:
    """Number of a column from 0, by its letters."""
    n = 0
    for c in name:
        n = n * 26 + ord(c) - 64
    return n - 1


def _letters(n: int) -> str:
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def _texts(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def rows_of(data: bytes) -> Iterator[list[str | None]]:
    """The cells of the first sheet, row by row; an empty cell is null."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = book.namelist()
        shared = [_texts(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        sheet = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        for row in ElementTree.fromstring(book.read(sheet)).iter(f"{_MAIN}row"):
            cells: list[str | None] = []
            for cell in row.iter(f"{_MAIN}c"):
                at = _column(re.sub(r"\d", "", cell.get("r", ""))) if cell.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                value = cell.find(f"{_MAIN}v")
                kind = cell.get("t")
                if kind == "inlineStr":
                    cells[at] = _texts(cell)
                elif value is not None and value.text is not None:
                    cells[at] = shared[int(value.text)] if kind == "s" else {"1": "true", "0": "false"}.get(value.text, value.text) if kind == "b" else value.text
            yield cells


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook, its first row as names, all cells as text. Names that are missing
    or there twice get their column's letters; a sheet without rows has no columns and no rows."""
    data = spark.read.format("binaryFile").load(path).select("content").first()
    rows = list(rows_of(bytes(data[0]))) if data else []
    if len(rows) > MOST_ROWS + 1:
        raise ValueError(f"{path} has more than {MOST_ROWS} rows")
    width = max((len(r) for r in rows), default=0)
    names: list[str] = []
    for i, n in enumerate((rows[0] if rows else []) + [None] * (width - len(rows[0] if rows else []))):
        names.append(n if n and n not in names else _letters(i))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.createDataFrame([tuple(r + [None] * (width - len(r))) for r in rows[1:]], schema)


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_BAD.sub("", str(value)))}</t></is></c>'


def write_xlsx(path: str, **sheets: DataFrame) -> None:
    """A workbook with a sheet per table, names first; nested values as text. Controls that a workbook
    can't hold are left out; a table without rows has its names."""
    parts: dict[str, str] = {}
    for n, df in enumerate(sheets.values(), 1):
        rows = df.limit(MOST_ROWS + 1).collect()
        if len(rows) > MOST_ROWS:
            raise ValueError(f"more than {MOST_ROWS} rows")
        lines = "".join("<row>" + "".join(map(_cell, r)) + "</row>" for r in [df.columns, *rows])
        parts[f"xl/worksheets/sheet{n}.xml"] = f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{lines}</sheetData></worksheet>'
    names = list(enumerate(sheets, 1))
    listed = "".join(f'<sheet name="{escape(name)}" sheetId="{n}" r:id="rId{n}"/>' for n, name in names)
    parts["xl/workbook.xml"] = f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{listed}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = _RELS.format(items="".join(_REL.format(n=n, kind="worksheet", target=f"worksheets/sheet{n}.xml") for n, _ in names))
    parts["_rels/.rels"] = _RELS.format(items=_REL.format(n=1, kind="officeDocument", target="xl/workbook.xml"))
    parts["[Content_Types].xml"] = _TYPES.format(sheets="".join(_SHEET_TYPE.format(n=n) for n, _ in names))
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
    fs, target = file_system(path)
    fs.create_dir(target.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(target) as out:
        out.write(whole.getvalue())
