"""Workbooks as a source and a sink: SpreadsheetML by the standard library alone.

``read_xlsx`` gives the rows below the header as strings, with ``excel_row``. Workbooks are read through Spark's binary files,
from any storage that Spark reads: one by one task, several by several; a workbook is held whole (its format is no
stream). A header ends at its first blank cell; of two equal headers the last column counts. Blank rows inside the sheet
are kept. The header is that of the first workbook by path.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
P = "{http://schemas.openxmlformats.org/package/2006/relationships}"
#: Built-in number formats that show dates or times.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
EPOCH = dt.datetime(1899, 12, 30)


class SheetError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n


def _letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def _text(number: str, is_date: bool) -> str:
    """A numeric cell as text: dates in ISO form, whole numbers without a fraction."""
    value = float(number)
    if is_date:
        at = EPOCH + dt.timedelta(days=value)
        at = (at + dt.timedelta(microseconds=500_000)).replace(microsecond=0)
        if value < 1:
            return at.strftime("%H:%M:%S")
        return at.strftime("%Y-%m-%d") if value == int(value) else at.strftime("%Y-%m-%d %H:%M:%S")
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def read_rows(data: bytes, sheet: str | None = None) -> tuple[dict[int, dict[int, str]], list[str]]:
    """Cells by row and column of a sheet (the first if none is named), and the names of all sheets."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        book = ET.fromstring(z.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(f"{P}Relationship")}
    except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
        raise SheetError("E_OPEN_XLSX", str(e)) from None
    sheets = {s.get("name"): links[s.get(f"{R}id")] for s in book.iter(f"{M}sheet")}
    if sheet is not None and sheet not in sheets:
        raise SheetError("E_OPEN_XLSX", f"no sheet {sheet}")
    target = sheets[sheet] if sheet is not None else next(iter(sheets.values()))
    names = set(z.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(f"{M}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{M}si")]
    dates: list[bool] = []
    if "xl/styles.xml" in names:
        style = ET.fromstring(z.read("xl/styles.xml"))
        own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in style.iter(f"{M}numFmt")}
        for xf in style.findall(f"{M}cellXfs/{M}xf"):
            k = int(xf.get("numFmtId", 0))
            code = re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(k, ""))
            dates.append(k in DATE_FORMATS or bool(re.search(r"[ymdhs]", code, re.I)))
    rows: dict[int, dict[int, str]] = {}
    path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    for _, row in ET.iterparse(io.BytesIO(z.read(path))):
        if row.tag != f"{M}row":
            continue
        cells = rows.setdefault(int(row.get("r")), {})
        for c in row.iter(f"{M}c"):
            kind, v = c.get("t", "n"), c.find(f"{M}v")
            if kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iter(f"{M}t"))
            elif v is None or v.text is None:
                continue
            elif kind == "s":
                value = shared[int(v.text)]
            elif kind == "n":
                style = int(c.get("s", 0))
                value = _text(v.text, style < len(dates) and dates[style])
            else:
                value = v.text
            cells[_column(c.get("r"))] = value
        row.clear()
    return rows, list(sheets)


def headers(rows: dict[int, dict[int, str]], header_row: int) -> dict[str, int]:
    """Names of the header and their columns."""
    out: dict[str, int] = {}
    column, cells = 1, rows.get(header_row, {})
    while cells.get(column, "").strip():
        out[cells[column].strip()] = column
        column += 1
    if not out:
        raise SheetError("E_HEADER_NOT_FOUND", f"row {header_row} has no header")
    return out


def _content(spark: SparkSession, path: str) -> DataFrame:
    """path and content of the workbooks at a path or glob of any file system that Spark reads."""
    try:
        return spark.read.format("binaryFile").load(path).select("path", "content")
    except AnalysisException as e:
        raise SheetError("E_OPEN_XLSX", str(e).splitlines()[0]) from None


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None, header_row: int = 1) -> DataFrame:
    """excel_row and the columns of the first workbook's header, as text; one task for each workbook."""

    def names(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(1):
                try:
                    found = [None, *headers(read_rows(data.as_py(), sheet)[0], header_row)]
                except SheetError as e:
                    found = [f"{e.code}|{e}"]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int32()), pa.array(found, pa.string())], ["at", "name"])

    files = _content(spark, path)
    top = files.orderBy("path").limit(1).mapInArrow(names, "at int, name string").orderBy("at").collect()
    if not top or top[0].name is not None:
        code, _, message = (top[0].name if top else "E_OPEN_XLSX|no workbook").partition("|")
        raise SheetError(code, message)
    wanted = [r.name for r in top[1:]]
    schema = StructType([StructField("excel_row", IntegerType()), *[StructField(n, StringType()) for n in wanted]])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(1):
                cells = read_rows(data.as_py(), sheet)[0]
                at, last = headers(cells, header_row), max(cells, default=0)
                for lo in range(header_row + 1, last + 1, 10_000):
                    numbers = range(lo, min(lo + 10_000, last + 1))
                    columns = [pa.array([cells.get(r, {}).get(at[n]) if n in at else None for r in numbers], pa.string()) for n in wanted]
                    yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), *columns], ["excel_row", *wanted])

    return files.mapInArrow(rows, schema)


def write_xlsx(rows: Iterable[tuple], names: list[str], path: str, sheet: str = "Sheet1") -> int:
    """A workbook of one sheet, written row by row; null cells are left out. Returns the number of rows."""

    def cell(column: int, row: int, value) -> str:
        ref = f"{_letters(column)}{row}"
        if value is None:
            return ""
        if isinstance(value, bool):
            return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)):
            return f'<c r="{ref}"><v>{value!r}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    base = "http://schemas.openxmlformats.org"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{base}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{base}/package/2006/relationships"><Relationship Id="rId1" Type="{base}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{base}/spreadsheetml/2006/main" xmlns:r="{base}/officeDocument/2006/relationships"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{base}/package/2006/relationships"><Relationship Id="rId1" Type="{base}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        n = 1
        with z.open("xl/worksheets/sheet1.xml", "w") as out:
            out.write(f'<worksheet xmlns="{base}/spreadsheetml/2006/main"><sheetData>'.encode())
            for row in [tuple(names)]:
                out.write(f'<row r="1">{"".join(cell(k, 1, v) for k, v in enumerate(row, 1))}</row>'.encode())
            for row in rows:
                n += 1
                out.write(f'<row r="{n}">{"".join(cell(k, n, v) for k, v in enumerate(row, 1))}</row>'.encode())
            out.write(b"</sheetData></worksheet>")
    return n - 1


def export_xlsx(df: DataFrame, path: str, sheet: str = "Sheet1") -> int:
    """A DataFrame as a workbook, streamed through the driver (a sheet is bounded by the format itself).

    A path with a scheme is written through Hadoop's file systems.
    """
    rows = (tuple(r) for r in df.toLocalIterator())
    if "://" not in path:
        return write_xlsx(rows, df.columns, path, sheet)
    context = df.sparkSession.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    with tempfile.TemporaryDirectory(prefix="sheetflow-") as folder:
        n = write_xlsx(rows, df.columns, f"{folder}/book.xlsx", sheet)
        target.getFileSystem(context._jsc.hadoopConfiguration()).copyFromLocalFile(False, True, context._jvm.org.apache.hadoop.fs.Path(f"file://{folder}/book.xlsx"), target)
    return n


def dump_csv(df: DataFrame, path: str) -> None:
    """The distributed sink for outputs beyond a sheet."""
    df.write.mode("overwrite").option("header", True).csv(path)
