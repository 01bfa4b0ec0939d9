"""Tables from one file format to another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellflow.sources import markup, xlsx


def import_tables(docs: DataFrame, id_col: str, text_col: str, kind: str, columns: list[str], path: str) -> DataFrame:
    """The tables of Markdown, HTML or JSON documents as workbooks under ``path``: body rows, cells by place, kept as text."""
    cells = markup.table_cells(docs, id_col, text_col, kind).where("row_no > 0")
    made = [F.max(F.when(F.col("column_no") == i, F.col("value"))).alias(c) for i, c in enumerate(columns)]
    rows = cells.groupBy("doc_id", "table_no", "row_no").agg(*made)
    return xlsx.save_workbooks(rows.select(*columns), path)


def export_workbooks(spark: SparkSession, path: str, header: list[str], kind: str = "markdown", **options) -> DataFrame:
    """Each sheet of the workbooks at ``path`` as one document ``(doc_id, text)``; its rows keep their order."""
    rows = xlsx.as_table(xlsx.read_cells(spark, path, **options), header)
    keyed = rows.select(F.xxhash64("path", "sheet").alias("_doc"), "_row", *header)
    return markup.documents(keyed, "_doc", "_row", kind, hidden=("_row",))
