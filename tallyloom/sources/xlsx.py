"""Spreadsheets: a Python data source ``xlsx`` that reads cells and writes sheets, on zipfile and ElementTree alone.

Reading gives one row per cell (sheet, row_num, col_num, ref, text, num, style, is_date); a sheet is one input
partition.  ``as_table`` turns a sheet's cells into rows of text columns.  A workbook is one file that one task has to
parse, so the source suits many small workbooks, not one large table.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import date, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_SCHEMA = "path string, sheet string, row_num int, col_num int, ref string, text string, num double, style int, is_date boolean"
#: Built-in number formats that show dates.
_DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


class WorkbookError(ValueError):
    """A workbook that cannot be read, with a stable ``code``."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def split_reference(ref: str) -> tuple[int, int]:
    """(column, row) of a reference such as AB12, both from 1."""
    m = re.fullmatch(r"([A-Z]+)(\d+)", ref)
    if not m:
        raise WorkbookError("badReference", ref)
    column = 0
    for c in m[1]:
        column = column * 26 + ord(c) - 64
    return column, int(m[2])


def reference(column: int, row: int) -> str:
    letters = ""
    while column:
        column, rest = divmod(column - 1, 26)
        letters = chr(65 + rest) + letters
    return f"{letters}{row}"


@dataclass
class Workbook:
    """The parts of a workbook that its cells need."""

    archive: zipfile.ZipFile
    sheets: dict[str, str]
    shared: list[str]
    date_styles: list[bool]

    @classmethod
    def open(cls, data: bytes) -> Workbook:
        try:
            z = zipfile.ZipFile(io.BytesIO(data))
            book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
            raise WorkbookError("notXlsx", str(e)) from e
        names = set(z.namelist())
        rels = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))} if "xl/_rels/workbook.xml.rels" in names else {}
        sheets = {}
        for s in book.iter(f"{_MAIN}sheet"):
            target = rels.get(s.get(f"{_REL}id"), "")
            sheets[s.get("name", "")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        if not sheets:
            raise WorkbookError("noSheets", "the workbook has no sheet")
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        styles = []
        if "xl/styles.xml" in names:
            root = ElementTree.fromstring(z.read("xl/styles.xml"))
            own = {int(n.get("numFmtId", 0)): n.get("formatCode", "") for n in root.iter(f"{_MAIN}numFmt")}
            listed = root.find(f"{_MAIN}cellXfs")
            for xf in listed if listed is not None else ():
                code = int(xf.get("numFmtId", 0))
                plain = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(code, ""))
                styles.append(code in _DATE_FORMATS or bool(re.search(r"[dmy]", plain, re.I)) and not re.search(r"[0#]", plain))
        return cls(z, sheets, shared, styles)

    def cells(self, sheet: str) -> Iterator[tuple]:
        """(row, column, ref, text, number, style, is_date) of the cells that hold something."""
        if sheet not in self.sheets:
            raise WorkbookError("sheetNotFound", sheet)
        with self.archive.open(self.sheets[sheet]) as part:
            for _, row in ElementTree.iterparse(part):
                if row.tag != f"{_MAIN}row":
                    continue
                for c in row.iter(f"{_MAIN}c"):
                    ref, kind, style = c.get("r", ""), c.get("t", "n"), int(c.get("s", 0))
                    value = c.findtext(f"{_MAIN}v")
                    is_date = style < len(self.date_styles) and self.date_styles[style]
                    text, number = None, None
                    if kind == "s" and value is not None:
                        text = self.shared[int(value)]
                    elif kind == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    elif kind == "b" and value is not None:
                        text = "VERO" if value == "1" else "FALSO"
                    elif kind in ("str", "e") and value is not None:
                        text = value
                    elif value is not None:
                        number = float(value)
                        if is_date:
                            text = (date(1899, 12, 30) + timedelta(days=int(number))).strftime("%d/%m/%Y")
                        else:
                            text = str(int(number)) if number == int(number) and abs(number) < 2**53 else repr(number)
                    if text not in (None, ""):
                        column, line = split_reference(ref)
                        yield line, column, ref, text, number, style, bool(is_date)
                row.clear()


@dataclass
class _Sheet(InputPartition):
    path: str
    sheet: str


class _Reader(DataSourceReader):
    """Workbooks of a folder that is mounted on all machines; ``cells_of`` reads those of any other store."""

    def __init__(self, options: dict):
        self.path, self.sheet = options["path"].removeprefix("file://"), options.get("sheet")

    def partitions(self) -> Sequence[InputPartition]:
        from pathlib import Path

        top = Path(self.path)
        files = [top] if top.is_file() else sorted(p for p in top.rglob("*.xlsx") if not p.name.startswith((".", "~$")))
        return [_Sheet(str(p), s) for p in files for s in Workbook.open(p.read_bytes()).sheets if self.sheet in (None, s)]

    def read(self, partition: _Sheet) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            book = Workbook.open(f.read())
        for row, column, ref, text, number, style, is_date in book.cells(partition.sheet):
            yield partition.path, partition.sheet, row, column, ref, text, number, style, is_date


class _Writer(DataSourceWriter):
    """One workbook for each task, named by its partition."""

    def __init__(self, options: dict, schema, overwrite: bool):
        self.path, self.sheet, self.columns = options["path"], options.get("sheet", "Sheet1"), schema.names

    def write(self, rows: Iterator) -> WriterCommitMessage:
        import os

        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        part = TaskContext.get().partitionId()
        data = workbook_bytes(self.sheet, self.columns, ([None if v is None else str(v) for v in r] for r in rows))
        with open(os.path.join(self.path, f"part-{part:05d}.xlsx"), "wb") as f:
            f.write(data)
        return WriterCommitMessage()


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxSource)


def cells_of(files: DataFrame) -> DataFrame:
    """Cells of the workbooks in a table of files (path, content), parsed on the executors that read them."""
    import pyarrow as pa

    names = [x.split(" ")[0] for x in _SCHEMA.split(", ")]

    def run(batches):
        for batch in batches:
            for path, content in zip(*[batch.column(i).to_pylist() for i in (0, 1)], strict=True):
                book = Workbook.open(content)
                rows = [(path, sheet, *cell) for sheet in book.sheets for cell in book.cells(sheet)]
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(run, _SCHEMA)


def retyped(text: str | None) -> float | None:
    """The number that a text stands for in a cell: plain within 2**53 or 1,234.5; ids with leading zeros stay text."""
    if text and re.fullmatch(r"-?(0|[1-9]\d*)(\.\d+)?|-?[1-9]\d{0,2}(,\d{3})+(\.\d+)?", text):
        n = float(text.replace(",", ""))
        return n if abs(n) <= 2**53 else None
    return None


def workbook_bytes(sheet: str, columns: Sequence[str], rows, numbers: bool = True) -> bytes:
    """A workbook of one sheet; texts that are plain numbers become numbers unless ``numbers`` is off."""

    def cell(value: str | None, column: int, row: int) -> str:
        if value in (None, ""):
            return ""
        number = retyped(value) if numbers else None
        ref = reference(column, row)
        if number is not None:
            return f'<c r="{ref}"><v>{number:.17g}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'

    lines = []
    for i, row in enumerate([list(columns), *rows], 1):
        lines.append(f'<row r="{i}">' + "".join(cell(v, j, i) for j, v in enumerate(row, 1)) + "</row>")
    main, office = _MAIN[1:-1], _REL[1:-1]
    package = "http://schemas.openxmlformats.org/package/2006"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()


def with_edits(template: bytes, edits: Sequence[tuple[str, str, str]]) -> tuple[bytes, list[tuple[str, str]]]:
    """A workbook with cells (sheet, ref, value) replaced, their styles kept, and edits to unknown sheets left out."""
    book = Workbook.open(template)
    by_part: dict[str, dict[str, str]] = {}
    skipped = []
    for sheet, ref, value in edits:
        if sheet in book.sheets:
            by_part.setdefault(book.sheets[sheet], {})[ref] = value
        else:
            skipped.append((sheet, ref))
    ElementTree.register_namespace("", _MAIN[1:-1])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for item in book.archive.infolist():
            data = book.archive.read(item)
            if item.filename in by_part:
                data = _edit_sheet(data, by_part[item.filename])
            if item.filename != "xl/calcChain.xml":
                z.writestr(item, data)
    return out.getvalue(), skipped


def _edit_sheet(data: bytes, edits: dict[str, str]) -> bytes:
    root = ElementTree.fromstring(data)
    body = root.find(f"{_MAIN}sheetData")
    rows = {int(r.get("r", 0)): r for r in body}
    for ref, value in edits.items():
        column, line = split_reference(ref)
        if line not in rows:
            row = ElementTree.Element(f"{_MAIN}row", {"r": str(line)})
            body.insert(sum(n < line for n in rows), row)
            rows[line] = row
        row = rows[line]
        cell = next((c for c in row if c.get("r") == ref), None)
        if cell is None:
            cell = ElementTree.Element(f"{_MAIN}c", {"r": ref})
            row.insert(sum(split_reference(c.get("r"))[0] < column for c in row), cell)
        for child in list(cell):
            cell.remove(child)
        number = retyped(value)
        if number is not None:
            cell.attrib.pop("t", None)
            ElementTree.SubElement(cell, f"{_MAIN}v").text = f"{number:.17g}"
        else:
            cell.set("t", "inlineStr")
            ElementTree.SubElement(ElementTree.SubElement(cell, f"{_MAIN}is"), f"{_MAIN}t").text = value
    return ElementTree.tostring(root, xml_declaration=True, encoding="UTF-8")


def choose_sheet(names: Sequence[str], wanted: str | None = None) -> str:
    """The wanted sheet, else the first with an all-digits name, else the first."""
    if wanted is not None:
        if wanted not in names:
            raise WorkbookError("sheetNotFound", wanted)
        return wanted
    if not names:
        raise WorkbookError("noSheets", "the workbook has no sheet")
    return next((n for n in names if n.isdigit()), names[0])


def header_row(cells: DataFrame, known: Sequence[str], required: Sequence[str] = (), within: int = 50, least: int = 10) -> tuple[int, dict[str, int]]:
    """The row among the first ``within`` with the most known headers, and each header's column."""
    names = {" ".join(k.upper().split()) for k in known}
    best: tuple[int, int, dict[str, int]] = (0, 0, {})
    rows: dict[int, dict[str, int]] = {}
    for r in cells.filter(F.col("row_num") <= within).select("row_num", "col_num", "text").collect():
        name = " ".join(r["text"].upper().split())
        if name in names:
            rows.setdefault(r["row_num"], {}).setdefault(name, r["col_num"])
    for row in sorted(rows):
        if len(rows[row]) > best[0]:
            best = (len(rows[row]), row, rows[row])
    if best[0] < min(least, len(names)):
        raise WorkbookError("headerNotFound", f"{best[0]} known headers at most")
    if missing := [c for c in required if " ".join(c.upper().split()) not in best[2]]:
        raise WorkbookError("missingColumns", ", ".join(missing))
    return best[1], best[2]


def as_table(cells: DataFrame, header: int, columns: dict[str, int]) -> DataFrame:
    """Rows below a header as text columns with ``row_id``, the row's number; rows without any of the columns go."""
    picked = cells.filter((F.col("row_num") > header) & F.col("col_num").isin(*columns.values()))
    wide = picked.groupBy("row_num").pivot("col_num", list(columns.values())).agg(F.first("text"))
    return wide.select(F.col("row_num").cast("long").alias("row_id"), *[F.col(f"`{i}`").alias(name) for name, i in columns.items()])


def extra_columns(cells: DataFrame, header: int, columns: dict[str, int]) -> DataFrame:
    """(col_num, n): filled cells below the header outside the layout."""
    return cells.filter((F.col("row_num") > header) & ~F.col("col_num").isin(*columns.values())).groupBy("col_num").agg(F.count("*").alias("n"))


def structure(cells: DataFrame, max_row: int = 50, max_col: int = 26, longest: int = 60) -> DataFrame:
    """The upper left of each sheet in reading order, texts cut."""
    return cells.filter((F.col("row_num") <= max_row) & (F.col("col_num") <= max_col)).orderBy("sheet", "row_num", "col_num").select("sheet", "ref", F.left("text", F.lit(longest)).alias("text"))


def used_range(cells: DataFrame) -> DataFrame:
    """(sheet, rows, columns) that are in use."""
    return cells.groupBy("sheet").agg(F.max("row_num").alias("rows"), F.max("col_num").alias("columns"))


def first_per_cell(targets: DataFrame) -> DataFrame:
    """Values for cells (sheet, ref, value, ord): the first for each cell counts."""
    return targets.withColumn("_r", F.row_number().over(Window.partitionBy("sheet", "ref").orderBy("ord"))).filter("_r = 1").drop("_r")
