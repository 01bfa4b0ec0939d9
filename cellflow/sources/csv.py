"""CSV files: delimiter and encoding found on a sample, then Spark's own reader."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Delimiters that are looked for.
DELIMITERS = ",;\t|"


def detect_delimiter(sample: str) -> str:
    """The delimiter most frequent outside quotes in the first line that isn't empty."""
    line = next((x for x in sample.splitlines() if x.strip()), "")
    counts, quoted = dict.fromkeys(DELIMITERS, 0), False
    for c in line:
        quoted ^= c == '"'
        if not quoted and c in counts:
            counts[c] += 1
    best = max(DELIMITERS, key=lambda d: (counts[d], -DELIMITERS.index(d)))
    return best if counts[best] else ","


def detect_encoding(head: bytes) -> str:
    """By byte order mark; else UTF-8 where it decodes, else Windows-1252."""
    if head.startswith(b"\xff\xfe"):
        return "UTF-16LE"
    if head.startswith(b"\xfe\xff"):
        return "UTF-16BE"
    for cut in range(4):  # the sample may end inside a character
        try:
            head[: len(head) - cut].decode("utf-8")
            return "UTF-8"
        except UnicodeDecodeError:
            continue
    return "windows-1252"


def first_bytes(spark: SparkSession, path: str, size: int = 65_536) -> bytes:
    """The first bytes of the first file that isn't empty at a path or pattern, through Spark's own file system."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(context._jsc.hadoopConfiguration())
    todo = sorted(system.globStatus(where) or [], key=lambda s: s.getPath().toString(), reverse=True)
    while todo:
        at = todo.pop()
        if at.getPath().getName()[0] in "_." and at.getPath().toString() != where.toString():
            continue
        if at.isDirectory():
            todo += sorted(system.listStatus(at.getPath()), key=lambda s: s.getPath().toString(), reverse=True)
        elif at.getLen():
            stream = system.open(at.getPath())
            try:
                return bytes(stream.readNBytes(size))
            finally:
                stream.close()
    return b""


def detect_format(head: bytes) -> str:
    """What a file is by its first bytes: xlsx, xls, html, json, markdown or csv."""
    if head.startswith(b"PK\x03\x04"):
        return "xlsx"
    if head.startswith(b"\xd0\xcf\x11\xe0"):
        return "xls"
    start = head.decode(detect_encoding(head), "replace").lstrip("\ufeff \t\r\n")
    if re.match(r"(?i)<(!doctype html|html|table|body|head)\b", start):
        return "html"
    if start[:1] in ("{", "["):
        return "json"
    return "markdown" if re.search(r"(?m)^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-+:?\s*)*\|?\s*$", start) and "|" in start else "csv"


#: Encodings that Spark's reader takes itself.
NATIVE = {"utf-8", "us-ascii", "iso-8859-1", "utf-16", "utf-16le", "utf-16be", "utf-32"}


def recoded(x: Column, encoding: str) -> Column:
    """Text that was read byte by byte, in its own encoding."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v if v is None else v.encode("latin-1").decode(encoding, "replace"))

    return run(x)


def read_csv(spark: SparkSession, path: str, header: bool = True, delimiter: str | None = None, encoding: str | None = None, infer: bool = False, skip_blank: bool = True, one_line: bool = False) -> DataFrame:
    """All columns as text, or with ``infer`` by the conservative rules of ``typed``.

    Cells may hold line ends, so a file is read by one task; promise with
    ``one_line`` that none does, and large files are split.
    """
    head = first_bytes(spark, path) if delimiter is None or encoding is None else b""
    encoding = encoding or detect_encoding(head)
    delimiter = delimiter or detect_delimiter(head.decode(encoding, "replace").lstrip("\ufeff"))
    native = encoding.lower() in NATIVE
    rows = spark.read.csv(path, header=header, sep=delimiter, encoding=encoding if native else "ISO-8859-1", multiLine=not one_line or encoding.upper().startswith("UTF-16"), quote='"', escape='"', mode="PERMISSIVE")
    if not native:
        rows = rows.select(*[recoded(F.col(f"`{c}`"), encoding).alias(c.encode("latin-1").decode(encoding, "replace")) for c in rows.columns])
    rows = rows.toDF(*[c.lstrip("\ufeff") for c in rows.columns])
    if skip_blank:
        rows = rows.dropna(how="all")
    return typed(rows) if infer else rows


def typed(df: DataFrame) -> DataFrame:
    """Columns whose filled cells are all numbers without leading zeros, or all true and false; others stay text, dates too."""
    number = r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$"
    texts = [c for c, t in df.dtypes if t == "string"]
    tests = [F.bool_and(F.col(c).rlike(number)).alias(f"n{i}") for i, c in enumerate(texts)] + [F.bool_and(F.lower(c).isin("true", "false")).alias(f"b{i}") for i, c in enumerate(texts)]
    found = df.agg(*tests).first() if texts else {}
    kinds = {c: "double" if found[f"n{i}"] else "boolean" if found[f"b{i}"] else "string" for i, c in enumerate(texts)}
    return df.select(*[F.col(c).cast(kinds.get(c, t)).alias(c) for c, t in df.dtypes])


def infer_cell(x: Column) -> Column:
    """A cell's kind: ``b``, ``n``, ``t`` or null where it is empty."""
    number = r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$"
    return F.when(F.trim(x) == "", None).when(F.lower(x).isin("true", "false"), "b").when(x.rlike(number), "n").otherwise("t")


def write_csv(df: DataFrame, path: str, header: bool = True, delimiter: str = ",", encoding: str = "UTF-8", mode: str = "error", line_end: str = "\n", mark: bool = False) -> None:
    """One file a task; ``mark`` puts a byte order mark before each (as part of its first line)."""
    if mark:
        first = df.columns[0] if header else None
        df = df.withColumnRenamed(first, "\ufeff" + first) if header else df
    if encoding.lower() not in NATIVE:

        @F.pandas_udf("string")
        def bytes_as_text(values: pd.Series) -> pd.Series:
            return values.map(lambda v: v if v is None else v.encode(encoding, "replace").decode("latin-1"))

        df = df.select(*[bytes_as_text(F.col(f"`{c}`").cast("string")).alias(c.encode(encoding, "replace").decode("latin-1")) for c in df.columns])
        encoding = "ISO-8859-1"
    df.write.csv(path, header=header, sep=delimiter, encoding=encoding, quote='"', escape='"', lineSep=line_end, mode=mode)
