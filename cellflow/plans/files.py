"""Queries that write files and read them again, and those of operators that work on whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellflow.functions.core import call
from cellflow.operators import aggregates as A
from cellflow.operators import dynamic
from cellflow.operators.ordinal import shared_folder
from cellflow.plans.queries import query, r6, table
from cellflow.sources import csv, markup, xlsx

#: Cells with quotes, delimiters and line ends, as SQL that Spark and DuckDB share.
_ODD = "p_name || ', \"' || p_brand || '\" | <' || chr(10) || 'second & last' AS s"
PART = f"SELECT p_partkey AS k, {_ODD}, p_size AS n, p_retailprice AS x FROM part"


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr("p_partkey AS k", _ODD, "p_size AS n", "p_retailprice AS x")


def _csv(name: str, **options) -> None:
    @query(name, PART)
    def run(spark, d):
        path = folder(spark, name)
        csv.write_csv(parts(spark, d), path, **options)
        known = {k: v for k, v in options.items() if k in ("delimiter", "encoding")} if options.get("encoding", "UTF-8") != "UTF-8" else {}
        back = csv.read_csv(spark, path, **known)
        return back.selectExpr("CAST(k AS BIGINT) AS k", "s", "CAST(n AS INT) AS n", "CAST(x AS DOUBLE) AS x")


_csv("file_csv")
_csv("file_csv_semicolons", delimiter=";")
_csv("file_csv_marked", mark=True)
_csv("file_csv_gbk", encoding="GBK", delimiter="\t")
_csv("file_csv_utf16", encoding="UTF-16LE", delimiter=",")


@query("file_csv_typed", "SELECT o_orderkey AS k, o_totalprice AS x, o_orderkey % 2 = 0 AS b, '00' || o_custkey AS t FROM orders")
def file_csv_typed(spark, d):
    path = folder(spark, "file_csv_typed")
    csv.write_csv(table(spark, d, "orders").selectExpr("o_orderkey AS k", "o_totalprice AS x", "o_orderkey % 2 = 0 AS b", "concat('00', o_custkey) AS t"), path)
    return csv.read_csv(spark, path, infer=True, one_line=True).selectExpr("CAST(k AS BIGINT) AS k", "x", "b", "t")


@query("file_xlsx", "SELECT o_orderkey AS k, o_orderpriority AS s, o_totalprice AS x, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderkey % 2 = 0 AS b FROM orders")
def file_xlsx(spark, d):
    path = folder(spark, "file_xlsx")
    rows = table(spark, d, "orders").selectExpr("o_orderkey AS k", "o_orderpriority AS s", "o_totalprice AS x", "CAST(o_orderdate AS DATE) AS d", "o_orderkey % 2 = 0 AS b")
    xlsx.save_workbooks(rows, path, rows_each=2000)
    back = xlsx.as_table(xlsx.read_cells(spark, f"{path}/*.xlsx", sheet="Sheet1"), ["k", "s", "x", "d", "b"])
    return back.selectExpr("CAST(k AS BIGINT) AS k", "s", "CAST(x AS DOUBLE) AS x", "d", "b = '1' AS b")


@query("file_xlsx_sheets", "SELECT 'first' AS sheet, 0 AS sheet_no, count(*) AS files FROM region HAVING count(*) > 0")
def file_xlsx_sheets(spark, d):
    path = folder(spark, "file_xlsx_sheets")
    xlsx.save_workbooks(table(spark, d, "region").coalesce(1), path, rows_each=1, sheet="first")
    return xlsx.sheet_names(spark, f"{path}/*.xlsx").groupBy("sheet", "sheet_no").agg(F.count(F.lit(1)).alias("files"))


@query("file_xlsx_row_range", "SELECT n_nationkey AS k, n_name AS s FROM nation WHERE n_nationkey BETWEEN 4 AND 9")
def file_xlsx_row_range(spark, d):
    path = folder(spark, "file_xlsx_row_range")
    xlsx.save_workbooks(table(spark, d, "nation").select("n_nationkey", "n_name").coalesce(1).sortWithinPartitions("n_nationkey"), path)
    cells = xlsx.read_cells(spark, f"{path}/*.xlsx", first_row=5, last_row=10)  # below one header row
    return xlsx.as_table(cells, ["k", "s"], first_row=5).selectExpr("CAST(k AS INT) AS k", "s")


def _documents(kind: str) -> None:
    @query(f"file_{kind}", PART.replace("AS s,", "AS s,").replace("SELECT", "SELECT p_partkey // 100 AS doc_id, 'Parts' AS table_name,"))
    def run(spark, d):
        path = folder(spark, f"file_{kind}")
        markup.documents(parts(spark, d).withColumn("g", F.floor(F.col("k") / 100)), "g", "k", kind, "Parts").write.parquet(path)
        cells = markup.table_cells(spark.read.parquet(path), "doc_id", "text", kind).where("row_no > 0")
        back = cells.groupBy("doc_id", "table_name", "row_no").pivot("column_no", [0, 1, 2, 3]).agg(F.first("value"))
        return back.selectExpr("doc_id", "table_name", "CAST(`0` AS BIGINT) AS k", "`1` AS s", "CAST(`2` AS INT) AS n", "CAST(`3` AS DOUBLE) AS x")


for _kind in ("markdown", "html", "json"):
    _documents(_kind)


@query("file_formats", "SELECT * FROM (VALUES ('csv', 'csv'), ('xlsx', 'xlsx')) AS t (made, found)")
def file_formats(spark, d):
    regions, found = table(spark, d, "region"), []
    for kind in ("csv", "xlsx"):
        path = folder(spark, kind)
        csv.write_csv(regions, path) if kind == "csv" else xlsx.save_workbooks(regions, path)
        found.append((kind, csv.detect_format(csv.first_bytes(spark, path))))
    return spark.createDataFrame(found, "made string, found string")


@query(
    "linest_trend",
    """WITH a AS (SELECT count(*)::DOUBLE AS n, regr_slope(y, x) AS m, regr_intercept(y, x) AS b, regr_r2(y, x) AS r, regr_sxx(y, x) AS sxx, regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x) AS e, regr_sxy(y, x) ** 2 / regr_sxx(y, x) AS g, avg(x) AS mx
       FROM (SELECT l_extendedprice AS y, l_quantity AS x FROM lineitem))
       SELECT round(m, 4) AS slope, round(b, 3) AS intercept, round(sqrt(e / (n - 2) / sxx), 6) AS slope_error, round(sqrt(e / (n - 2)) * sqrt(1 / n + mx * mx / sxx), 4) AS intercept_error, round(r, 8) AS r_squared,
         round(sqrt(e / (n - 2)), 4) AS y_error, round(g / (e / (n - 2)), 2) AS f, n - 2 AS freedom, round(b + 30 * m, 3) AS trend FROM a""",
)
def linest_trend(spark, d):
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    found, places = A.linest(y, x), {"slope": 4, "intercept": 3, "slope_error": 6, "intercept_error": 4, "r_squared": 8, "y_error": 4, "f": 2, "freedom": 0}
    return table(spark, d, "lineitem").agg(*[F.round(found[c], p).alias(c) for c, p in places.items()], F.round(A.trend(30, y, x), 3).alias("trend"))


@query("paired_statistics", "SELECT round(covar_pop(l_quantity, l_extendedprice), 3) AS cp, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2, round((SELECT avg((l_tax - m) ** 3) / pow(avg((l_tax - m) ** 2), 1.5) FROM lineitem, (SELECT avg(l_tax) AS m FROM lineitem)), 6) AS sp FROM lineitem")
def paired_statistics(spark, d):
    q, x = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, d, "lineitem").agg(F.round(A.covariance_p(q, x), 3).alias("cp"), F.round(A.rsq(x, q), 8).alias("r2"), r6(A.skew_p(F.col("l_tax"))).alias("sp"))


@query("percentiles_exc", "WITH s AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) AS r, count(*) OVER () AS n FROM orders), k AS (SELECT *, 0.3 * (n + 1) AS p FROM s) SELECT round(sum(CASE WHEN r = floor(p) THEN x * (1 - (p - floor(p))) WHEN r = floor(p) + 1 THEN x * (p - floor(p)) ELSE 0 END), 4) AS p30 FROM k")
def percentiles_exc(spark, d):
    return A.percentiles(table(spark, d, "orders"), "o_totalprice", exclusive=True, p30=0.3).select(F.round("p30", 4).alias("p30"))


@query("percentrank_exc", "SELECT o_orderkey, floor(rank() OVER (ORDER BY o_totalprice) / (count(*) OVER () + 1) * 1000) / 1000 AS pr FROM orders")
def percentrank_exc(spark, d):
    return dynamic.percent_rank_exc(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "pr").select("o_orderkey", "pr")


@query("torow", "SELECT n_nationkey * 2 + 1 AS cell, n_name AS value FROM nation UNION ALL SELECT n_nationkey * 2 + 2, CAST(n_regionkey AS VARCHAR) FROM nation")
def torow(spark, d):
    return dynamic.to_row(table(spark, d, "nation"), "n_nationkey").selectExpr("CAST(_cell AS BIGINT) AS cell", "value")


@query("wrapcols", "SELECT n_nationkey % 7 + 1 AS line, n_nationkey // 7 + 1 AS col, n_name AS value FROM nation UNION ALL SELECT unnest([5, 6, 7]), 4, '-'")
def wrapcols(spark, d):
    return dynamic.wrap_columns(table(spark, d, "nation"), "n_name", "n_nationkey", 7, "-").selectExpr("CAST(_line AS INT) AS line", "CAST(_column AS INT) AS col", "value")


@query("array_shapes", "SELECT p_partkey AS k, 2 AS r, 3 AS c, p_name AS h FROM part")
def array_shapes(spark, d):
    cells = F.array(F.array("p_size", "p_size", "p_size"), F.array("p_size", "p_size", "p_size"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), call("ROWS", cells).alias("r"), call("COLUMNS", cells).alias("c"), call("HYPERLINK", "https://example.org", F.col("p_name")).alias("h"))
