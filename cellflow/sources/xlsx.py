"""XLSX workbooks: one file a task on reading, one part a task on writing."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "path string, sheet string, row_no int, column_no int, kind string, value string"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINKS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

ROW, VALUE, TEXT = f"{MAIN}row", f"{MAIN}v", f"{MAIN}t"


def column_number(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


#: Numbers of the built-in formats that show dates or times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), 45, 46, 47, *range(50, 59)}


def is_date_format(code: str) -> bool:
    """Whether a format code shows a date or a time: y, m, d, h or s outside quotes, escapes and brackets."""
    return bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]|general', "", code.split(";")[0].lower())))


def date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.parse(z.open("xl/styles.xml")).getroot()
    own = {int(n.get("numFmtId")): n.get("formatCode") or "" for n in root.iter(f"{MAIN}numFmt")}
    formats = [int(x.get("numFmtId") or 0) for group in root.iter(f"{MAIN}cellXfs") for x in group]
    return {i for i, n in enumerate(formats) if n in DATE_FORMATS or is_date_format(own.get(n, ""))}


def serial_text(value: str, epoch_1904: bool) -> str:
    """A serial number as ISO date, or date and time; as it is where it is no day."""
    try:
        number = float(value) + (1462 if epoch_1904 else 0)
    except ValueError:
        return value
    if not 0 <= number < 2_958_466:
        return value
    day = datetime.datetime(1899, 12, 30 if number >= 60 else 31) + datetime.timedelta(seconds=round(number * 86_400))
    return day.strftime("%Y-%m-%d" if number == int(number) else "%Y-%m-%d %H:%M:%S")


def sheets_of(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """``(name, part)`` of the sheets, in order."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.parse(z.open("xl/_rels/workbook.xml.rels")).getroot()}
    found = [(s.get("name"), targets[s.get(f"{LINKS}id")].lstrip("/")) for s in ElementTree.parse(z.open("xl/workbook.xml")).getroot().iter(f"{MAIN}sheet")]
    return [(name, part if part.startswith("xl/") else f"xl/{part}") for name, part in found]


def workbook_cells(content: bytes, wanted: str | int | None = None, first: int = 0, last: int | None = None, epoch_1904: bool | None = None):
    """``(sheet, row, column, kind, value)`` of filled cells, streamed by row; kinds are n, t, b, d (dates) and e.

    ``wanted`` is a sheet's name or number from 0, ``first`` and ``last`` bound
    the rows (both counted); other sheets are not decoded.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for _, item in ElementTree.iterparse(z.open("xl/sharedStrings.xml")):
                if item.tag == f"{MAIN}si":
                    shared.append("".join(t.text or "" for t in item.iter(f"{MAIN}t")))
                    item.clear()
        dates = date_styles(z)
        if epoch_1904 is None:
            epoch_1904 = any(p.get("date1904") in ("1", "true") for p in ElementTree.parse(z.open("xl/workbook.xml")).getroot().iter(f"{MAIN}workbookPr"))
        for number, (sheet, part) in enumerate(sheets_of(z)):
            if wanted is not None and wanted not in (sheet, number):
                continue
            at_row = -1
            for _, node in ElementTree.iterparse(z.open(part), ("end",)):
                if node.tag != ROW:
                    continue
                at_row = int(node.get("r", at_row + 2)) - 1
                if last is not None and at_row > last:
                    break
                at_column = -1
                for c in node if at_row >= first else ():
                    at_column = column_number(c.get("r")) if c.get("r") else at_column + 1
                    kind = c.get("t", "n")
                    if kind == "inlineStr":
                        value, kind = "".join(t.text or "" for t in c.iter(TEXT)), "t"
                    else:
                        body = c.find(VALUE)
                        if body is None or body.text is None:
                            continue
                        value = shared[int(body.text)] if kind == "s" else body.text
                        kind = {"s": "t", "str": "t", "b": "b", "e": "e", "d": "d"}.get(kind, "n")
                        if kind == "n" and int(c.get("s") or 0) in dates:
                            kind, value = "d", serial_text(value, epoch_1904)
                    yield sheet, at_row, at_column, kind, value
                node.clear()


def cells_of(files: DataFrame, sheet: str | int | None = None, first_row: int = 0, last_row: int | None = None, epoch_1904: bool | None = None) -> DataFrame:
    """Filled cells of workbooks ``(path, content)``; a file is one task's work, its rows leave in batches."""

    def run(frames):
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                rows: list[tuple] = []
                for cell in workbook_cells(bytes(content), sheet, first_row, last_row, epoch_1904):
                    rows.append((name, *cell))
                    if len(rows) >= 20_000:
                        yield pd.DataFrame(rows, columns=[c.split()[0] for c in CELLS.split(", ")])
                        rows = []
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in CELLS.split(", ")])

    return files.select("path", "content").mapInPandas(run, CELLS)


def read_cells(spark: SparkSession, path: str, **options) -> DataFrame:
    """``cells_of`` the workbooks at a path or pattern."""
    return cells_of(spark.read.format("binaryFile").load(path), **options)


def sheet_names(spark: SparkSession, path: str) -> DataFrame:
    """``(path, sheet_no, sheet)`` of all workbooks; no sheet is decoded."""

    def run(frames):
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    rows += [(name, i, sheet) for i, (sheet, _) in enumerate(sheets_of(z))]
            yield pd.DataFrame(rows, columns=["path", "sheet_no", "sheet"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, sheet_no int, sheet string")


def as_table(cells: DataFrame, header: list[str], first_row: int = 1) -> DataFrame:
    """Rows of one sheet's cells as columns of text, with ``_row`` from 1."""
    columns = [F.max(F.when(F.col("column_no") == i, F.col("value"))).alias(name) for i, name in enumerate(header)]
    rows = cells.where(F.col("row_no") >= first_row).groupBy("path", "sheet", "row_no").agg(*columns)
    return rows.select("path", "sheet", (F.col("row_no") - first_row + 1).alias("_row"), *header)


def workbook(rows: list[tuple], header: list[str], sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet, strings inline."""

    def cell(v) -> str:
        if v is None or v != v:
            return "<c/>"
        if isinstance(v, datetime.datetime):
            return f'<c s="2"><v>{(v - datetime.datetime(1899, 12, 30)) / datetime.timedelta(days=1)!r}</v></c>'
        if isinstance(v, datetime.date):
            return f'<c s="1"><v>{(v - datetime.date(1899, 12, 30)).days}</v></c>'
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    main = MAIN.strip("{}")
    body = "".join(f'<row r="{i + 1}">{"".join(map(cell, row))}</row>' for i, row in enumerate([tuple(header), *rows]))
    # fixed values: part names, content types and relationships of the file format
    files = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{LINKS.strip("{}")}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{LINKS.strip("{}")}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{LINKS.strip("{}")}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{LINKS.strip("{}")}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def workbooks(df: DataFrame, rows_each: int = 100_000, sheet: str = "Sheet1") -> DataFrame:
    """``(part, content)``: the rows as workbooks of at most ``rows_each`` rows, made where the rows are."""
    header = df.columns

    def run(frames):
        held: list[tuple] = []
        for frame in frames:
            held += [tuple(v.item() if hasattr(v, "item") else v for v in r) for r in frame.itertuples(index=False)]
            while len(held) >= rows_each:
                yield pd.DataFrame({"content": [workbook(held[:rows_each], header, sheet)]})
                held = held[rows_each:]
        if held:
            yield pd.DataFrame({"content": [workbook(held, header, sheet)]})

    return _shown(df).mapInPandas(run, "content binary").select(F.monotonically_increasing_id().alias("part"), "content")


def _shown(df: DataFrame) -> DataFrame:
    """Columns that a workbook holds as they are, others as text."""
    return df.select(*[F.col(c) if t in ("double", "float", "bigint", "int", "boolean", "date", "timestamp", "timestamp_ntz") else F.col(c).cast("string").alias(c) for c, t in df.dtypes])


def save_workbooks(df: DataFrame, path: str, rows_each: int = 100_000, sheet: str = "Sheet1") -> DataFrame:
    """Write the rows as workbooks of at most ``rows_each`` rows in a folder that all executors reach; gives ``(path, size)``.

    A file is named by its task's number, so a task that runs again writes the same files.
    """

    def run(frames):
        from pyarrow import fs
        from pyspark import TaskContext

        system, folder = fs.FileSystem.from_uri(path)
        system.create_dir(folder, recursive=True)
        task, n = TaskContext.get().partitionId(), 0
        for frame in frames:
            for content in frame["content"]:
                name = f"{folder}/part-{task:05d}-{n:04d}.xlsx"
                with system.open_output_stream(f"{name}.{TaskContext.get().taskAttemptId()}") as out:
                    out.write(bytes(content))
                system.move(f"{name}.{TaskContext.get().taskAttemptId()}", name)
                n += 1
                yield pd.DataFrame({"path": [name], "size": [len(content)]})

    done = workbooks(df, rows_each, sheet).select("content").mapInPandas(run, "path string, size bigint")
    return df.sparkSession.createDataFrame(done.toPandas())  # a row for each file
