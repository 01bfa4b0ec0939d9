"""Tables inside Markdown, HTML and JSON documents, one document a row."""

from __future__ import annotations

import html
import itertools
import json
import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = "doc_id bigint, table_no int, table_name string, row_no int, column_no int, value string"
_CELL_TYPES = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string())


def gfm_tables(text: str) -> list[tuple[str, list[list[str]]]]:
    """Pipe tables with the heading above each; every cell stays text."""
    tables, heading, lines, i = [], "", text.splitlines(), 0
    while i < len(lines):
        line = lines[i].strip()
        if m := re.match(r"#{1,6}\s+(.*?)\s*#*$", line):
            heading = m[1]
        if "|" in line and i + 1 < len(lines) and "|" in lines[i + 1] + "|" and re.fullmatch(r"\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?", lines[i + 1].strip()):
            rows = [pipe_cells(line)]
            i += 2
            while i < len(lines) and "|" in lines[i]:
                cells = pipe_cells(lines[i])[: len(rows[0])]
                rows.append(cells + [""] * (len(rows[0]) - len(cells)))
                i += 1
            tables.append((heading, rows))
            continue
        i += 1
    return tables


def pipe_cells(line: str) -> list[str]:
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    line = line[:-1] if line.endswith("|") and not line.endswith(r"\|") else line
    return [c.strip().replace(r"\|", "|").replace("<br>", "\n") for c in re.split(r"(?<!\\)\|", line)]


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__()
        self.done, self.open, self.cell = [], [], None

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag == "table":
            self.open.append({"name": given.get("id") or "", "rows": [], "held": {}, "caption": False})
        elif self.open:
            table = self.open[-1]
            if tag == "caption":
                table["caption"], table["name"] = True, ""
            elif tag == "tr":
                table["rows"].append({})
            elif tag in ("td", "th") and table["rows"]:
                self._close()
                self.cell = [[], self._span(given, "rowspan"), self._span(given, "colspan")]
            elif tag == "br" and self.cell:
                self.cell[0].append("\n")

    @staticmethod
    def _span(given, name) -> int:
        """As HTML limits it: 1,000 columns and 65,534 rows."""
        value = (given.get(name) or "").strip()
        return max(1, min(int(value[:9]), 1000 if name == "colspan" else 65_534)) if value.isdecimal() else 1

    def _close(self):
        if not self.cell or not self.open or not self.open[-1]["rows"]:
            return
        parts, height, width = self.cell
        table = self.open[-1]
        row, at = table["rows"][-1], len(table["rows"]) - 1
        column = 0
        while column in row or table["held"].get(column, -1) >= at:
            column += 1
        row[column] = " ".join("".join(parts).split(" ")).strip()
        for c in range(width):  # the last row that each column is held to
            table["held"][column + c] = max(table["held"].get(column + c, -1), at + height - 1)
        self.cell = None

    def handle_endtag(self, tag):
        if not self.open:
            return
        if tag in ("td", "th", "tr"):
            self._close()
        elif tag == "caption":
            self.open[-1]["caption"] = False
        elif tag == "table":
            self._close()
            self.done.append(self.open.pop())

    def handle_data(self, data):
        if self.open and self.open[-1]["caption"]:
            self.open[-1]["name"] += data
        elif self.cell:
            self.cell[0].append(data)


def html_tables(text: str) -> list[tuple[str, list[dict[int, str]]]]:
    """All tables with caption or id; spanned cells stay empty."""
    parser = _Tables()
    parser.feed(text)
    parser.close()
    return [(t["name"].strip(), t["rows"]) for t in parser.done]


def json_tables(text: str) -> list[tuple[str, list[list[str | None]]]]:
    """Tables of a JSON document: an array of objects or of arrays, or ``{"tables": [{"name": ..., "rows": ...}]}``.

    Objects give a header row of all their keys, in the order they appear; nested values stay JSON.
    """

    def shown(v) -> str | None:
        return v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)

    def grid(rows) -> list[list[str | None]]:
        if rows and all(isinstance(r, dict) for r in rows):
            keys = list(dict.fromkeys(k for r in rows for k in r))
            return [list(keys), *([shown(r.get(k)) for k in keys] for r in rows)]
        return [[shown(v) for v in r] if isinstance(r, list) else [shown(r)] for r in rows]

    try:
        found = json.loads(text)
    except ValueError:
        return []
    if isinstance(found, dict) and isinstance(found.get("tables"), list):
        out = []
        for one in found["tables"]:
            name, rows = (one.get("name") or "", one.get("rows") or []) if isinstance(one, dict) else ("", one)
            head = one.get("columns") or one.get("headers") if isinstance(one, dict) else None
            out.append((str(name), ([[shown(v) for v in head]] if head else []) + grid(rows if isinstance(rows, list) else [])))
        return out
    return [("", grid(found if isinstance(found, list) else [found]))]


READERS = {"markdown": gfm_tables, "html": lambda text: html_tables(text), "json": json_tables}


def cell_batches(batches: Iterable[pa.RecordBatch], kind: str, at_a_time: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Cells of ``(doc, text)`` rows, a bounded number at a time, whatever the number of documents in a batch."""

    def cells():
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):  # one document at a time is a Python string
                for t, (name, rows) in enumerate(READERS[kind](text.as_py())):
                    for r, row in enumerate(rows):
                        for c, value in row.items() if isinstance(row, dict) else enumerate(row):
                            yield doc.as_py(), t, name, r, c, value

    found = cells()
    while some := list(itertools.islice(found, at_a_time)):
        yield pa.RecordBatch.from_arrays([pa.array(v, of) for v, of in zip(zip(*some, strict=True), _CELL_TYPES, strict=True)], names=[c.split()[0] for c in CELLS.split(", ")])


def table_cells(docs: DataFrame, id_col: str, text_col: str, kind: str) -> DataFrame:
    """Cells of all tables in each document, as ``CELLS``; documents without a table give none."""
    given = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return given.mapInArrow(lambda batches: cell_batches(batches, kind), CELLS)


def escaped_html(x: Column) -> Column:
    out = F.coalesce(x.cast("string"), F.lit(""))
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def html_row(columns: list[str]) -> Column:
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), escaped_html(F.col(f"`{c}`")), F.lit("</td>")) for c in columns], F.lit("</tr>"))


def markdown_row(columns: list[str]) -> Column:
    """Pipes and line ends inside cells are escaped."""
    cells = [F.replace(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>")) for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def json_row(columns: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})


def html_rows(df: DataFrame) -> DataFrame:
    """A ``<tr>`` line for each row."""
    return df.select(html_row(df.columns).alias("value"))


def markdown_rows(df: DataFrame) -> DataFrame:
    """A pipe-table line for each row."""
    return df.select(markdown_row(df.columns).alias("value"))


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(json_row(df.columns).alias("value"))


def documents(df: DataFrame, key: str, order: str, kind: str, title: str = "", hidden: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, text)``: a whole document with one table for each value of ``key``; rows in ``order``, header first.

    Columns in ``hidden`` are not shown.

    A document is one string, so a key should have no more rows than fit one file.
    """
    columns = [c for c in df.columns if c != key and c not in hidden]
    if kind == "markdown":
        line, row = markdown_row, "| " + " | ".join(c.replace("|", "\\|") for c in columns) + " |\n|" + " --- |" * len(columns) + "\n"
        start, between, end = (f"## {title}\n\n" if title else "") + row, "\n", "\n"
    elif kind == "html":
        line, names = html_row, "".join(f"<th>{html.escape(c)}</th>" for c in columns)
        start, between, end = f"<table><caption>{html.escape(title)}</caption>\n<tr>{names}</tr>\n", "\n", "\n</table>\n"
    else:
        line, (start, between, end) = json_row, ('{"tables": [{"name": ' + json.dumps(title) + ', "rows": [', ", ", "]}]}")
    value = line(columns)
    made = df.groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))).alias("rows"))
    return made.select("doc_id", F.concat(F.lit(start), F.array_join(F.transform("rows", lambda r: r["v"]), between), F.lit(end)).alias("text"))


def filled_template(df: DataFrame, template: str) -> DataFrame:
    r"""Each row's text of a template: ``{field}`` and ``{.field}`` are filled, ``\{`` and ``\}`` are braces."""
    parts, names = [], {c.lower(): c for c in df.columns}
    for m in re.finditer(r"\\([{}])|\{\.?(\w+)\}|([^\\{]+|.)", template, re.S):
        if m[1]:
            parts.append(F.lit(m[1]))
        elif m[2]:
            parts.append(F.coalesce(F.col(names[m[2].lower()]).cast("string"), F.lit("")) if m[2].lower() in names else F.lit(""))
        else:
            parts.append(F.lit(m[3]))
    return df.select("*", F.concat(*parts).alias("filled"))
