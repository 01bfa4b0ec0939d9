"""Queries of rows mapped to typed columns and back, of row streams, and of steps given as column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellflow.functions.core import num
from cellflow.operators import dynamic, lookup
from cellflow.plans.files import folder
from cellflow.plans.queries import query, table
from cellflow.sources import csv, exchange, markup, xlsx
from cellflow.sources.rows import Field, failures, map_rows, stored, with_missing, within_limits
from cellflow.streaming import each_page, read_landing

#: Columns of text, as a reader gives them.
_TEXTS = (
    "CAST(p_partkey AS STRING) AS ` Part key `",
    "concat(' ', p_size, ' ') AS size",
    "format_number(p_partkey * 1000, 0) AS thousands",
    "CAST(CAST(p_retailprice AS DECIMAL(20,2)) AS STRING) AS price",
    "concat(p_size, '.5') AS half",
    "concat(p_size, '%') AS percent",
    "CASE p_size % 3 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'no' END AS flag",
    "CAST(p_size % 3 AS STRING) AS zero_one_two",
    "CASE WHEN p_size % 2 = 0 THEN 'TRUE' ELSE 'false' END AS truth",
    "CAST(date_add(DATE '1996-01-01', p_size) AS STRING) AS day",
    "date_format(date_add(DATE '1996-01-01', p_size), 'dd.MM.yyyy') AS german",
    "CAST(35065 + p_size AS STRING) AS serial",
    "concat(date_add(DATE '1996-01-01', p_size), ' 06:30:00') AS moment",
    "concat(35065 + p_size, '.25') AS quarter",
    "p_name AS name",
)
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal(20,4)")


def _texts(spark, d):
    return table(spark, d, "part").selectExpr(*_TEXTS)


@query(
    "rows_numbers",
    """SELECT p_partkey AS k, p_size AS as_tinyint, p_size AS as_smallint, p_size AS as_int, CAST(p_size AS BIGINT) AS as_bigint, p_partkey * 1000 AS thousands,
       CAST(p_retailprice AS DOUBLE) AS price, CAST(p_retailprice AS DOUBLE) AS price_decimal, p_size + 0.5::DOUBLE AS half, p_size + 0.5::DOUBLE AS half_float, round(p_size / 100, 6) AS percent, true AS half_int FROM part""",
)
def rows_numbers(spark, d):
    fields = [Field("k", "bigint", headers=("Part key",)), *[Field(f"as_{k}", k, headers=("size",)) for k in _NUMBERS[:4]], Field("thousands", "bigint"), Field("price", "double"), Field("price_decimal", "decimal(20,4)", headers=("price",))]
    fields += [Field("half", "double"), Field("half_float", "float", headers=("half",)), Field("percent", "double"), Field("half_int", "int", headers=("half",))]
    out = map_rows(_texts(spark, d), fields)
    wide = {"as_tinyint": "int", "as_smallint": "int", "price_decimal": "double", "half_float": "double"}
    return out.select(*[F.round(c, 6).alias(c) if c == "percent" else F.isnull(c).alias(c) if c == "half_int" else F.col(c).cast(wide.get(c, out.schema[c].dataType)).alias(c) for c in out.columns])


@query(
    "rows_booleans",
    "SELECT p_partkey AS k, CASE p_size % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS flag, p_size % 3 = 1 AS one, "
    + ", ".join(f"CAST(p_size % 2 = 0 AS INT)::DOUBLE AS truth_{i}" for i in range(len(_NUMBERS)))
    + ", CASE WHEN p_size % 2 = 0 THEN 'TRUE' ELSE 'false' END AS truth_text FROM part",
)
def rows_booleans(spark, d):
    fields = [Field("k", "bigint", index=0), Field("flag", "boolean"), Field("one", "boolean", headers=("zero_one_two",)), Field("truth_text", headers=("truth",))]
    out = map_rows(_texts(spark, d), fields + [Field(f"truth_{i}", k, headers=("truth",)) for i, k in enumerate(_NUMBERS)])
    return out.select(*[F.col(c).cast("double").alias(c) if c[-1].isdigit() else F.col(c).cast("string").alias(c) if c == "flag" else F.col(c) for c in out.columns])


@query(
    "rows_dates",
    """SELECT p_partkey AS k, s AS day, s AS german, s AS serial, s || ' 00:00:00' AS midnight, s || ' 06:30:00' AS moment, s || ' 06:30:00' AS patterned, s || ' 06:00:00' AS quarter
       FROM (SELECT p_partkey, strftime(DATE '1996-01-01' + p_size, '%Y-%m-%d') AS s FROM part)""",
)
def rows_dates(spark, d):
    fields = [Field("k", "bigint", index=0), Field("day", "date"), Field("german", "date", pattern="dd.MM.yyyy"), Field("serial", "date"), Field("midnight", "timestamp", headers=("day",))]
    fields += [Field("moment", "timestamp"), Field("patterned", "timestamp", headers=("moment",), pattern="yyyy-MM-dd HH:mm:ss"), Field("quarter", "timestamp")]
    out = map_rows(_texts(spark, d), fields)
    shown = {"date": "yyyy-MM-dd", "timestamp": "yyyy-MM-dd HH:mm:ss"}
    return out.select(*[F.date_format(c, shown[t]).alias(c) if t in shown else F.col(c) for c, t in out.dtypes])


@query(
    "rows_stored",
    """SELECT o_orderkey AS k, o_orderkey % 3 = 1 AS one, CAST(o_orderkey % 2 = 0 AS INT)::DOUBLE AS flag_number, CASE WHEN o_orderkey % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS flag_text, CAST(o_orderkey AS VARCHAR) AS key_text,
       CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS DOUBLE) AS day_number, strftime(o_orderdate, '%d/%m/%Y') AS day_text, round(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) + 0.75, 6) AS moment_number,
       o_orderkey::DOUBLE AS text_number, o_orderkey % 2 = 0 AS text_boolean FROM orders""",
)
def rows_stored(spark, d):
    day, flag = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 2 == 0
    cells = {
        "one": stored(F.col("o_orderkey") % 3, "bigint", "boolean"),
        "flag_number": stored(flag, "boolean", "number"),
        "flag_text": stored(flag, "boolean", "text"),
        "key_text": stored(F.col("o_orderkey"), "bigint", "text"),
        "day_number": stored(day, "date", "number"),
        "day_text": stored(day, "date", "text", "dd/MM/yyyy"),
        "moment_number": F.round(stored(day.cast("timestamp") + F.expr("INTERVAL 18 HOURS"), "timestamp", "number"), 6),
        "text_number": stored(F.col("o_orderkey").cast("string"), "string", "number"),
        "text_boolean": stored(flag.cast("string"), "string", "boolean"),
    }
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), *[c.alias(n) for n, c in cells.items()])


_PARTS = [Field("key", "bigint", index=0, headers=("Part key",)), Field("label", order=2, headers=("name",)), Field("size", "int", order=1), Field("note", default="none")]


@query(
    "rows_selected",
    """SELECT p_partkey AS key, CAST(p_size AS INT) AS size, p_name AS label, 'none' AS note, 'key,size,label,note' AS all_columns, 'size,label' AS at, 'key,note' AS without_at, 'label,key' AS named, 'label,size' AS placed, 'key,label,note' AS without FROM part""",
)
def rows_selected(spark, d):
    rows = _texts(spark, d)
    ways = {
        "all_columns": {},
        "at": {"include_at": [2, 1]},
        "without_at": {"exclude_at": [1, 2]},
        "named": {"include": ["label", "key"], "as_included": True},
        "placed": {"include_at": [2, 1], "as_included": True},
        "without": {"exclude": ["size"]},
    }
    layouts = {name: ",".join(map_rows(rows, _PARTS, **how).columns) for name, how in ways.items()}
    return map_rows(rows, _PARTS).select("*", *[F.lit(v).alias(n) for n, v in layouts.items()])


@query("rows_blank", "SELECT p_partkey AS k, trim(p_name) AS name, coalesce(CASE WHEN p_size > 25 THEN p_size END, -1) AS size FROM part WHERE p_size > 25 OR p_partkey % 2 = 0")
def rows_blank(spark, d):
    filled = "p_size > 25 OR p_partkey % 2 = 0"
    rows = table(spark, d, "part").selectExpr(f"IF({filled}, CAST(p_partkey AS STRING), ' ') AS k", f"IF({filled}, concat('  ', p_name, ' '), '') AS name", "IF(p_size > 25, CAST(p_size AS STRING), NULL) AS size")
    return map_rows(rows, [Field("k", "bigint"), Field("name", convert=lambda x: F.trim(x)), Field("size", "int", default=-1)], trim=True)


@query("rows_failures", "SELECT 'half' AS field, CAST(p_size AS VARCHAR) || '.5' AS value FROM part UNION ALL SELECT 'day', p_name FROM part")
def rows_failures(spark, d):
    return failures(_texts(spark, d), [Field("key", "bigint", headers=("Part key",)), Field("half", "int"), Field("size", "int"), Field("day", "date", headers=("name",))])


@query("rows_missing", "SELECT CAST(r AS INT) AS row, n_name AS name FROM range(0, 40) t(r) LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 1) n ON n_nationkey = r")
def rows_missing(spark, d):
    rows = table(spark, d, "nation").where("n_nationkey % 3 <> 1").selectExpr("CAST(n_nationkey AS INT) AS row", "n_name AS name")
    return with_missing(rows, "row", 0, 39)


@query("rows_within_limits", "SELECT p_partkey AS k, p_name AS name FROM part")
def rows_within_limits(spark, d):
    return within_limits(table(spark, d, "part").selectExpr("p_partkey AS k", "p_name AS name"), columns=2, characters=200)


@query("stream_pages", "SELECT n_regionkey AS region, count(*) AS rows, CAST(sum(n_nationkey) AS BIGINT) AS total FROM nation GROUP BY 1")
def stream_pages(spark, d):
    landed, pages, state = folder(spark, "landed"), folder(spark, "pages"), folder(spark, "state")
    csv.write_csv(table(spark, d, "nation").select("n_nationkey", "n_regionkey").repartition(5), landed)
    rows = read_landing(spark, landed, "n_nationkey bigint, n_regionkey int", files_each=2)
    # a page written twice after a restart replaces itself
    each_page(rows, lambda page, n: page.write.mode("overwrite").parquet(f"{pages}/page={n}"), state).awaitTermination()
    return spark.read.parquet(pages).groupBy(F.col("n_regionkey").alias("region")).agg(F.count(F.lit(1)).alias("rows"), F.sum("n_nationkey").alias("total"))


def _nations(spark, d, kind):
    return markup.documents(table(spark, d, "nation").select("n_regionkey", "n_nationkey", "n_name"), "n_regionkey", "n_nationkey", kind, "Nations")


@query("import_markdown", "SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS name FROM nation")
def import_markdown(spark, d):
    path = folder(spark, "import_markdown")
    exchange.import_tables(_nations(spark, d, "markdown"), "doc_id", "text", "markdown", ["k", "name"], path)
    return xlsx.as_table(xlsx.read_cells(spark, f"{path}/*.xlsx"), ["k", "name"]).select("k", "name")


@query("export_markdown", "SELECT '| k | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) || chr(10) AS text FROM nation")
def export_markdown(spark, d):
    path = folder(spark, "export_markdown")
    xlsx.save_workbooks(table(spark, d, "nation").select("n_nationkey", "n_name").coalesce(1).sortWithinPartitions("n_nationkey"), path)
    return exchange.export_workbooks(spark, f"{path}/*.xlsx", ["k", "name"]).select("text")


@query("text_arithmetic", "SELECT p_partkey AS k, p_size + 1.5::DOUBLE AS plus, p_size * -2.0::DOUBLE AS times, round(p_size / 7, 6) AS over, round(pow(p_size, 1.5), 6) AS power, -CAST(p_size AS DOUBLE) AS minus, round(p_size / 100, 6) AS percent, p_size || '-' || p_brand AS joined FROM part")
def text_arithmetic(spark, d):
    size = num(F.concat(F.lit(" "), F.col("p_size").cast("string")))
    joined = F.concat(F.col("p_size").cast("string"), F.lit("-"), "p_brand")
    out = [(size + num("1.5")).alias("plus"), (size * -2).alias("times"), F.round(size / 7, 6).alias("over"), F.round(F.pow(size, num("1.5")), 6).alias("power"), (-size).alias("minus")]
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), *out, F.round(num(F.concat(F.col("p_size").cast("string"), F.lit("%"))), 6).alias("percent"), joined.alias("joined"))


@query("lookup_wildcard", "SELECT p_partkey AS k, p_name AS name FROM part WHERE lower(p_name) LIKE '%_e%n%' ORDER BY p_partkey LIMIT 1")
def lookup_wildcard(spark, d):
    return lookup.wildcard_match(table(spark, d, "part"), "*?E*n*", "p_name", "p_partkey").selectExpr("p_partkey AS k", "p_name AS name")


@query("lambda_steps", "SELECT p_partkey AS k, CAST(p_size * 2 + p_partkey AS DOUBLE) AS mapped, CAST(((10 + p_size) * 2 + p_size + 1) * 2 AS DOUBLE) AS reduced, CAST(p_size AS DOUBLE) AS first, CAST(2 * p_size AS DOUBLE) AS second, CAST(2 * p_size * (p_size + 1) AS DOUBLE) AS third FROM part")
def lambda_steps(spark, d):
    cells = F.array(F.col("p_size").cast("double"), F.col("p_size") + 1.0)
    rows = dynamic.map_cells(table(spark, d, "part"), "mapped", lambda size, key: size * 2.0 + key, "p_size", "p_partkey")
    reduced = dynamic.reduce_row(cells, 10, lambda so_far, x: (so_far + x) * 2)
    scanned = dynamic.scan_row(F.array(F.col("p_size").cast("double"), F.lit(2.0), F.col("p_size") + 1.0), 1, lambda so_far, x: so_far * x)
    return rows.select(F.col("p_partkey").alias("k"), "mapped", reduced.alias("reduced"), *[scanned[i].alias(n) for i, n in enumerate(("first", "second", "third"))])


@query("outer_product", "SELECT p_partkey AS k, CAST(c AS INT) AS col, p_size * [2, 3, 5][c + 1] AS value FROM part, range(0, 3) t(c)")
def outer_product(spark, d):
    return dynamic.outer(table(spark, d, "part"), "p_size", [2, 3, 5], lambda a, b: a * b).selectExpr("p_partkey AS k", "_column AS col", "value")
