"""Named queries of the worksheet operators, and the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellflow.functions.core import call
from cellflow.operators import aggregates as A
from cellflow.operators import cashflow, database, dynamic, lookup
from cellflow.operators.criteria import every
from cellflow.operators.ordinal import dealt, numbered
from cellflow.sources.csv import infer_cell
from cellflow.sources.markup import escaped_html, filled_template, json_rows, markdown_rows

for _module in ("math", "text", "datetime", "logic", "engineering", "distributions", "financial"):
    importlib.import_module(f"cellflow.functions.{_module}")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column) -> Column:
    return F.round(x, 6)


def named(df: DataFrame, *keys: str, **columns: Column) -> DataFrame:
    return df.select(*keys, *[c.alias(n) for n, c in columns.items()])


# criteria and aggregates


@query("sumifs", "SELECT round(sum(l_extendedprice) FILTER (WHERE l_returnflag = 'R' AND l_quantity >= 25), 2) AS v FROM lineitem")
def sumifs(spark, d):
    t = table(spark, d, "lineitem")
    return t.agg(F.round(A.sumifs(t.l_extendedprice, t.l_returnflag, "R", t.l_quantity, ">=25"), 2).alias("v"))


@query("sumif_by_group", "SELECT l_returnflag, round(sum(CASE WHEN l_quantity > 25 THEN l_extendedprice ELSE 0 END), 2) AS v FROM lineitem GROUP BY 1")
def sumif_by_group(spark, d):
    t = table(spark, d, "lineitem")
    return t.groupBy("l_returnflag").agg(F.round(A.sumif(t.l_quantity, ">25", t.l_extendedprice), 2).alias("v"))


@query("countifs", "SELECT count(*) AS v FROM lineitem WHERE l_returnflag = 'A' AND l_discount <= 0.05")
def countifs(spark, d):
    t = table(spark, d, "lineitem")
    return t.agg(A.countifs(t.l_returnflag, "a", t.l_discount, "<=0.05").alias("v"))


@query("averageif", "SELECT round(avg(o_totalprice), 4) AS v FROM orders WHERE o_orderstatus = 'F'")
def averageif(spark, d):
    t = table(spark, d, "orders")
    return t.agg(F.round(A.averageif(t.o_orderstatus, "F", t.o_totalprice), 4).alias("v"))


@query("maxifs_minifs", "SELECT coalesce(max(o_totalprice), 0) AS mx, coalesce(min(o_totalprice), 0) AS mn FROM orders WHERE o_orderpriority LIKE '1%'")
def maxifs_minifs(spark, d):
    t = table(spark, d, "orders")
    return t.agg(A.maxifs(t.o_totalprice, t.o_orderpriority, "1*").alias("mx"), A.minifs(t.o_totalprice, t.o_orderpriority, "1*").alias("mn"))


@query("criteria_wildcards", "SELECT count(*) FILTER (WHERE lower(p_type) LIKE '%s%') AS a, count(*) FILTER (WHERE length(p_brand) = 8 AND lower(p_brand) LIKE 'brand#1_') AS b, count(*) FILTER (WHERE lower(p_type) <> 'promo') AS c FROM part")
def criteria_wildcards(spark, d):
    t = table(spark, d, "part")
    return t.agg(A.countifs(t.p_type, "*S*").alias("a"), A.countifs(t.p_brand, "Brand#1?").alias("b"), A.countifs(t.p_type, "<>promo").alias("c"))


@query("sumproduct", "SELECT round(sum(l_extendedprice * l_discount), 2) AS v FROM lineitem")
def sumproduct(spark, d):
    t = table(spark, d, "lineitem")
    return t.agg(F.round(A.sumproduct(t.l_extendedprice, t.l_discount), 2).alias("v"))


@query("sum_squares", "SELECT round(sum(l_quantity * l_quantity), 2) AS sq, round(sum(l_quantity * l_quantity - l_tax * l_tax), 2) AS m, round(sum(l_quantity * l_quantity + l_tax * l_tax), 2) AS p, round(sum((l_quantity - l_tax) * (l_quantity - l_tax)), 2) AS x FROM lineitem")
def sum_squares(spark, d):
    t = table(spark, d, "lineitem")
    q, x = t.l_quantity, t.l_tax
    return t.agg(*[F.round(c, 2).alias(n) for n, c in (("sq", A.sumsq(q)), ("m", A.sumx2my2(q, x)), ("p", A.sumx2py2(q, x)), ("x", A.sumxmy2(q, x)))])


@query("subtotal_codes", "SELECT round(avg(l_quantity), 6) AS s1, count(l_quantity) AS s2, count(l_quantity) AS s3, max(l_quantity) AS s4, min(l_quantity) AS s5, round(stddev_samp(l_quantity), 6) AS s7, round(stddev_pop(l_quantity), 6) AS s8, round(sum(l_quantity), 2) AS s9, round(var_samp(l_quantity), 6) AS s10, round(var_pop(l_quantity), 6) AS s11 FROM lineitem")
def subtotal_codes(spark, d):
    t = table(spark, d, "lineitem")
    return t.agg(*[(A.subtotal(k, t.l_quantity) if k in (2, 3, 4, 5) else F.round(A.subtotal(k, t.l_quantity), 2 if k == 9 else 6)).alias(f"s{k}") for k in (1, 2, 3, 4, 5, 7, 8, 9, 10, 11)])


@query("aggregate_codes", "SELECT median(o_totalprice) AS a12, round(quantile_cont(o_totalprice, 0.3), 6) AS a16, round(quantile_cont(o_totalprice, 0.75), 6) AS a17 FROM orders")
def aggregate_codes(spark, d):
    found = A.aggregates(table(spark, d, "orders"), "o_totalprice", a12=(12,), a16=(16, 0.3), a17=(17, 3))
    return found.select("a12", r6(F.col("a16")).alias("a16"), r6(F.col("a17")).alias("a17"))


@query("product_of", "SELECT c_nationkey, round(ln(product(1 + c_acctbal / 1e6)), 6) AS v FROM customer WHERE c_acctbal > -1e6 GROUP BY 1")
def product_of(spark, d):
    t = table(spark, d, "customer")
    return t.groupBy("c_nationkey").agg(r6(F.ln(A.product(1 + t.c_acctbal / 1e6))).alias("v"))


@query("counts", "SELECT count(*) AS n, count(p_name) AS a, count(*) FILTER (WHERE p_name IS NULL OR p_name = '') AS b FROM part")
def counts(spark, d):
    t = table(spark, d, "part")
    return t.agg(F.count(F.lit(1)).alias("n"), A.counta(t.p_name).alias("a"), A.countblank(t.p_name).alias("b"))


@query("percentile_inc", "SELECT quantile_cont(l_extendedprice, 0.25) AS q1, median(l_extendedprice) AS md, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem")
def percentile_inc(spark, d):
    found = A.percentiles(table(spark, d, "lineitem"), "l_extendedprice", q1=0.25, md=0.5, p90=0.9)
    return found.select("q1", "md", r6(F.col("p90")).alias("p90"))


@query("percentile_exc", "WITH s AS (SELECT p_brand, list(p_retailprice ORDER BY p_retailprice) AS v, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, 0.25 * (n + 1) AS k FROM s) SELECT p_brand, round(v[CAST(floor(k) AS INT)] + (k - floor(k)) * (v[CAST(floor(k) AS INT) + 1] - v[CAST(floor(k) AS INT)]), 6) AS v FROM r")
def percentile_exc(spark, d):
    t = table(spark, d, "part")
    return t.groupBy("p_brand").agg(r6(A.exclusive(t.p_retailprice, 0.25)).alias("v"))


@query("correl_regr", "SELECT round(corr(l_extendedprice, l_quantity), 8) AS r, round(regr_slope(l_extendedprice, l_quantity), 4) AS b, round(regr_intercept(l_extendedprice, l_quantity), 3) AS a, round(covar_samp(l_extendedprice, l_quantity), 3) AS cs, round(covar_pop(l_extendedprice, l_quantity), 3) AS cp, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2, round(regr_intercept(l_extendedprice, l_quantity) + 30 * regr_slope(l_extendedprice, l_quantity), 3) AS f FROM lineitem")
def correl_regr(spark, d):
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, d, "lineitem").agg(F.round(F.corr(y, x), 8).alias("r"), F.round(F.regr_slope(y, x), 4).alias("b"), F.round(F.regr_intercept(y, x), 3).alias("a"), F.round(F.covar_samp(y, x), 3).alias("cs"), F.round(F.covar_pop(y, x), 3).alias("cp"), F.round(F.regr_r2(y, x), 8).alias("r2"), F.round(A.forecast(30, y, x), 3).alias("f"))


@query("steyx_logest", "SELECT round(sqrt((regr_syy(y, x) - power(regr_sxy(y, x), 2) / regr_sxx(y, x)) / (regr_count(y, x) - 2)), 4) AS steyx, round(exp(regr_slope(ln(y), x)), 8) AS m, round(exp(regr_intercept(ln(y), x)), 3) AS b, round(exp(regr_intercept(ln(y), x) + 30 * regr_slope(ln(y), x)), 3) AS g FROM (SELECT l_extendedprice AS y, l_quantity AS x FROM lineitem)")
def steyx_logest(spark, d):
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    m, b = A.logest(y, x)
    return table(spark, d, "lineitem").agg(F.round(A.steyx(y, x), 4).alias("steyx"), F.round(m, 8).alias("m"), F.round(b, 3).alias("b"), F.round(A.growth(30, y, x), 3).alias("g"))


@query("skew_kurt", "SELECT round(skewness(c_acctbal), 6) AS sk, round(kurtosis(c_acctbal), 6) AS ku FROM customer")
def skew_kurt(spark, d):
    return table(spark, d, "customer").agg(r6(A.skew(F.col("c_acctbal"))).alias("sk"), r6(A.kurt(F.col("c_acctbal"))).alias("ku"))


@query("geomean_harmean", "SELECT round(exp(avg(ln(p_retailprice))), 6) AS g, round(count(*) / sum(1 / p_retailprice), 6) AS h, round(var_pop(p_retailprice) * count(*), 2) AS dv FROM part")
def geomean_harmean(spark, d):
    x = F.col("p_retailprice")
    return table(spark, d, "part").agg(r6(A.geomean(x)).alias("g"), r6(A.harmean(x)).alias("h"), F.round(A.devsq(x), 2).alias("dv"))


@query("avedev", "SELECT round(avg(abs(o_totalprice - m)), 4) AS avedev FROM orders, (SELECT avg(o_totalprice) AS m FROM orders)")
def avedev(spark, d):
    return A.averages(table(spark, d, "orders"), "o_totalprice").select(F.round("avedev", 4).alias("avedev"))


@query("trimmean", "WITH s AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) AS r, count(*) OVER () AS n FROM orders) SELECT round(avg(x), 4) AS trimmean FROM s WHERE r > floor(n * 0.2 / 2) AND r <= n - floor(n * 0.2 / 2)")
def trimmean(spark, d):
    return A.trimmed_mean(table(spark, d, "orders"), "o_totalprice", 0.2).select(F.round("trimmean", 4).alias("trimmean"))


@query("rank_eq_avg", "SELECT p_partkey, rank() OVER (ORDER BY p_size DESC) AS r, rank() OVER (ORDER BY p_size DESC) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS ra FROM part")
def rank_eq_avg(spark, d):
    t = dynamic.rank(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", name="r")
    return dynamic.rank(t, "p_size", average=True, name="ra").select("p_partkey", "r", F.col("ra").cast("double").alias("ra"))


@query("percentrank", "SELECT o_orderkey, floor((rank() OVER (ORDER BY o_totalprice) - 1) / (count(*) OVER () - 1) * 1000) / 1000 AS pr FROM orders")
def percentrank(spark, d):
    return dynamic.percent_rank(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "pr").select("o_orderkey", "pr")


@query("large_small", "SELECT (SELECT o_totalprice FROM orders ORDER BY 1 DESC LIMIT 1 OFFSET 4) AS l5, (SELECT o_totalprice FROM orders ORDER BY 1 LIMIT 1 OFFSET 4) AS s5")
def large_small(spark, d):
    t = table(spark, d, "orders")
    return dynamic.large_small(t, "o_totalprice", 5).select(F.col("value").alias("l5")).crossJoin(dynamic.large_small(t, "o_totalprice", 5, False).select(F.col("value").alias("s5")))


@query("mode_mult", "WITH c AS (SELECT p_size, count(*) AS n FROM part GROUP BY 1) SELECT p_size FROM c WHERE n = (SELECT max(n) FROM c) AND n > 1")
def mode_mult(spark, d):
    return dynamic.modes(table(spark, d, "part"), "p_size", "p_partkey")


@query("frequency", "SELECT CAST(CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 20 THEN 1 WHEN l_quantity <= 30 THEN 2 WHEN l_quantity <= 40 THEN 3 ELSE 4 END AS INT) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def frequency(spark, d):
    return dynamic.frequency(table(spark, d, "lineitem"), "l_quantity", [10, 20, 30, 40]).select(F.col("_bin").alias("bin"), "n")


@query("percentof", "SELECT o_orderstatus, round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 8) AS p FROM orders GROUP BY 1")
def percentof(spark, d):
    t = table(spark, d, "orders")
    total = t.agg(F.sum("o_totalprice").alias("total"))
    return t.groupBy("o_orderstatus").agg(F.sum("o_totalprice").alias("part")).crossJoin(F.broadcast(total)).select("o_orderstatus", F.round(F.col("part") / F.col("total"), 8).alias("p"))


@query("average_a", "SELECT round(avg(CAST(o_orderstatus = 'F' AS INT)), 8) AS a, round(stddev_samp(CAST(o_orderstatus = 'F' AS INT)), 8) AS s FROM orders")
def average_a(spark, d):
    x = A.as_values(F.col("o_orderstatus") == "F")
    return table(spark, d, "orders").agg(F.round(F.avg(x), 8).alias("a"), F.round(F.stddev_samp(x), 8).alias("s"))


@query("database_functions", "SELECT round(sum(l_extendedprice), 2) AS s, count(l_quantity) AS c, max(l_quantity) AS mx, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem WHERE (l_returnflag = 'A' AND l_quantity > 40) OR (l_returnflag = 'N' AND l_discount >= 0.08)")
def database_functions(spark, d):
    t = table(spark, d, "lineitem")
    rows = [{"L_RETURNFLAG": "A", "l_quantity": ">40"}, {"l_returnflag": "N", "l_discount": ">=0.08"}]
    parts = [database.aggregate(n, t, f, rows).select(c.alias(a)) for n, f, a, c in (("DSUM", "l_extendedprice", "s", F.round("value", 2)), ("DCOUNT", "l_quantity", "c", F.col("value")), ("DMAX", "l_quantity", "mx", F.col("value")), ("DSTDEV", "l_quantity", "sd", F.round("value", 6)))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


@query("dget", "SELECT c_name AS value FROM customer WHERE c_custkey = 7")
def dget(spark, d):
    return database.aggregate("DGET", table(spark, d, "customer"), "c_name", [{"c_custkey": "=7"}])


# lookups


@query("vlookup_exact", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def vlookup_exact(spark, d):
    return lookup.vlookup(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer"), "c_custkey", "c_name", "c_custkey").select("o_orderkey", "c_name")


@query("xlookup_if_not_found", "SELECT c_custkey, coalesce(n_name, 'none') AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 10")
def xlookup_if_not_found(spark, d):
    n = table(spark, d, "nation").where("n_nationkey < 10")
    return lookup.xlookup(table(spark, d, "customer"), "c_nationkey", n, "n_nationkey", "n_name", "n_nationkey", if_not_found="none", name="n").select("c_custkey", "n")


@query("xlookup_last", "SELECT c_custkey, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS k FROM customer")
def xlookup_last(spark, d):
    return lookup.xlookup(table(spark, d, "customer"), "c_custkey", table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderkey", last=True, name="k").select("c_custkey", "k")


@query("lookup_nearest", "SELECT c_custkey, (SELECT max(p_retailprice) FROM part WHERE p_retailprice <= c_acctbal) AS v, (SELECT min(p_retailprice) FROM part WHERE p_retailprice >= c_acctbal) AS w FROM customer")
def lookup_nearest(spark, d):
    c, p = table(spark, d, "customer").select("c_custkey", "c_acctbal"), table(spark, d, "part").select("p_partkey", "p_retailprice")
    below = lookup.nearest(c, "c_acctbal", p, "p_retailprice", "p_retailprice", "p_partkey", name="v")
    return lookup.nearest(below, "c_acctbal", p, "p_retailprice", "p_retailprice", "p_partkey", larger=True, name="w").select("c_custkey", "v", "w")


@query("lookup_asof", "SELECT p.event_id, max(e.ts) AS prev FROM events p LEFT JOIN events e ON e.event_type = 'signup' AND e.ts <= p.ts WHERE p.event_type = 'purchase' GROUP BY 1")
def lookup_asof(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "event_type")
    return lookup.nearest(e.where("event_type = 'purchase'"), "ts", e.where("event_type = 'signup'"), "ts", "ts", "event_id", name="prev").select("event_id", "prev")


@query("match_index", "SELECT c_custkey, i AS position, n_name FROM customer JOIN (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) ON n_nationkey = c_nationkey")
def match_index(spark, d):
    n = table(spark, d, "nation")
    found = lookup.match(table(spark, d, "customer"), "c_nationkey", n, "n_nationkey", "n_nationkey")
    rows = numbered(n.select("n_nationkey", "n_name"), "n_nationkey")
    return lookup.xlookup(found, "position", rows, "_row", "n_name", "_row").select("c_custkey", "position", "n_name")


@query("index_row", "SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 1 OFFSET 4")
def index_row(spark, d):
    return lookup.index(table(spark, d, "nation"), 5, "n_nationkey", "n_name")


@query("hlookup", "SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 1 OFFSET 2")
def hlookup(spark, d):
    return lookup.hlookup(table(spark, d, "nation"), "N_NAME", 4, "n_nationkey")


@query("offset", "SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 4 OFFSET 9")
def offset(spark, d):
    return lookup.offset(table(spark, d, "nation"), 10, 4, "n_nationkey", ["n_name"])


@query("countif_semi_anti", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has FROM customer")
def countif_semi_anti(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders")
    return lookup.matching(c, "c_custkey", o, "o_custkey").withColumn("has", F.lit(True)).union(lookup.matching(c, "c_custkey", o, "o_custkey", absent=True).withColumn("has", F.lit(False)))


@query("address", "SELECT p_partkey, '$' || chr(CAST(65 + p_size % 26 AS INT)) || '$' || p_partkey AS a FROM part")
def address(spark, d):
    return named(table(spark, d, "part"), "p_partkey", a=dynamic.address(F.col("p_partkey"), F.col("p_size") % 26 + 1))


# dynamic arrays


@query("dynamic_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
def dynamic_filter(spark, d):
    t = table(spark, d, "orders")
    return dynamic.filter_rows(t, every(t.o_totalprice, ">200000")).select("o_orderkey", "o_totalprice")


@query("dynamic_unique", "SELECT DISTINCT p_brand, p_type FROM part")
def dynamic_unique(spark, d):
    return dynamic.unique(table(spark, d, "part").select("p_brand", "p_type"))


@query("unique_exactly_once", "SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) = 1")
def unique_exactly_once(spark, d):
    return dynamic.unique(table(spark, d, "orders").select("o_custkey"), exactly_once=True)


@query("dynamic_sortby_take", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def dynamic_sortby_take(spark, d):
    return dynamic.take(table(spark, d, "orders"), 10, F.col("o_totalprice").desc(), "o_orderkey").select("o_orderkey")


@query("dynamic_sort", "SELECT n_nationkey, row_number() OVER (ORDER BY lower(n_name) DESC, n_nationkey) AS pos FROM nation")
def dynamic_sort(spark, d):
    t = table(spark, d, "nation")
    return numbered(t, F.lower("n_name").desc(), "n_nationkey", name="pos").select("n_nationkey", "pos")


@query("take_last", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 7")
def take_last(spark, d):
    return dynamic.take(table(spark, d, "orders"), -7, "o_orderkey").select("o_orderkey")


@query("drop_rows", "SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 1000")
def drop_rows(spark, d):
    return dynamic.drop(table(spark, d, "customer"), 1000, "c_custkey").select("c_custkey")


@query("choose_rows", "SELECT n_name FROM nation WHERE n_nationkey IN (0, 4, 24)")
def choose_rows(spark, d):
    return dynamic.choose_rows(table(spark, d, "nation"), [5, 1, -1], "n_nationkey").select("n_name")


@query("choose_columns", "SELECT r_name, r_regionkey FROM region")
def choose_columns(spark, d):
    return dynamic.choose_columns(table(spark, d, "region").select("r_regionkey", "r_name"), [-1, 1])


@query("vstack", "SELECT n_name AS v FROM nation UNION ALL SELECT r_name FROM region")
def vstack(spark, d):
    return dynamic.vstack(table(spark, d, "nation").select(F.col("n_name").alias("v")), table(spark, d, "region").select("r_name"))


@query("hstack", "SELECT n_nationkey, r_name FROM nation LEFT JOIN region ON n_nationkey = r_regionkey")
def hstack(spark, d):
    return dynamic.hstack((table(spark, d, "nation").select("n_nationkey"), "n_nationkey"), (table(spark, d, "region").select("r_regionkey", "r_name"), "r_regionkey")).select("n_nationkey", "r_name")


@query("to_column", "SELECT n_nationkey + 1 AS line, 0 AS col, n_name AS value FROM nation UNION ALL SELECT n_nationkey + 1, 1, CAST(n_regionkey AS VARCHAR) FROM nation")
def to_column(spark, d):
    cells = dynamic.to_column(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey")
    return cells.select(F.col("_row").cast("int").alias("line"), F.col("_column").alias("col"), "value")


@query("wrap_rows", "SELECT n_nationkey // 4 AS line, max(n_name) FILTER (WHERE n_nationkey % 4 = 0) AS c1, max(n_name) FILTER (WHERE n_nationkey % 4 = 1) AS c2, max(n_name) FILTER (WHERE n_nationkey % 4 = 2) AS c3, max(n_name) FILTER (WHERE n_nationkey % 4 = 3) AS c4 FROM nation GROUP BY 1")
def wrap_rows(spark, d):
    return dynamic.wrap_rows(table(spark, d, "nation"), "n_name", "n_nationkey", 4).withColumnRenamed("_line", "line")


@query("sequence", "SELECT i + 1 AS line, 5.0 + 3 * i AS value FROM range(100) t(i)")
def sequence(spark, d):
    return dynamic.sequence(spark, 100, 5, 3).withColumnRenamed("_row", "line")


@query("expand", "SELECT i AS line, r_name FROM range(1, 9) t(i) LEFT JOIN region ON r_regionkey = i - 1")
def expand(spark, d):
    return dynamic.expand(table(spark, d, "region").select("r_regionkey", "r_name"), 8, "r_regionkey").select(F.col("_row").alias("line"), "r_name")


@query("trim_range", "SELECT i FROM range(10, 51) t(i)")
def trim_range(spark, d):
    t = spark.range(100).select(F.col("id").alias("i"), F.when(F.col("id").between(10, 50) & (F.col("id") % 3 != 0) | F.col("id").isin(10, 50), F.lit("x")).alias("v"))
    return dynamic.trim_range(t, "i").select("i")


@query("scan_running", "SELECT event_id, round(sum(value) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 2) AS v FROM events")
def scan_running(spark, d):
    return dynamic.scan(table(spark, d, "events").select("event_id", "value"), "value", "event_id", "v").select("event_id", F.round("v", 2).alias("v"))


# scalar functions


@query("text_fns", "SELECT p_partkey, left(p_name, 3) AS l, right(p_name, 3) AS r, substr(p_name, 2, 4) AS m, length(p_name) AS n, upper(p_name) AS u, replace(p_name, ' ', '_') AS s, CASE WHEN contains(p_name, ' ') THEN split_part(p_name, ' ', 1) END AS b, left(p_name, 1) || 'XY' || substr(p_name, 4) AS p, repeat(left(p_name, 1), 3) AS t, instr(p_name, 'a') AS f FROM part")
def text_fns(spark, d):
    n = F.col("p_name")
    return named(table(spark, d, "part"), "p_partkey", l=call("LEFT", n, 3), r=call("RIGHT", n, 3), m=call("MID", n, 2, 4), n=call("LEN", n), u=call("UPPER", n), s=call("SUBSTITUTE", n, " ", "_"), b=call("TEXTBEFORE", n, " "), p=call("REPLACE", n, 2, 2, "XY"), t=call("REPT", call("LEFT", n, 1), 3), f=F.coalesce(call("FIND", "a", n), F.lit(0)))


@query("textjoin", "SELECT r_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS v FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def textjoin(spark, d):
    j = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    return j.groupBy("r_regionkey").agg(F.expr("listagg(n_name, ',') WITHIN GROUP (ORDER BY n_nationkey)").alias("v"))


@query("regex_fns", "SELECT p_partkey, regexp_matches(p_brand, '[0-9]{2}$') AS t, CASE WHEN regexp_matches(p_brand, '[0-9]+') THEN regexp_extract(p_brand, '[0-9]+') END AS e, regexp_replace(p_brand, '[0-9]', 'N', 'g') AS x FROM part")
def regex_fns(spark, d):
    b = F.col("p_brand")
    return named(table(spark, d, "part"), "p_partkey", t=call("REGEXTEST", b, "[0-9]{2}$"), e=call("REGEXEXTRACT", b, "[0-9]+"), x=call("REGEXREPLACE", b, "[0-9]", "N"))


@query("text_numbers", "SELECT o_orderkey, CAST(o_totalprice AS VARCHAR) = CAST(o_totalprice AS VARCHAR) AS same, round(o_totalprice, 1) AS v FROM orders")
def text_numbers(spark, d):
    x = F.col("o_totalprice")
    return named(table(spark, d, "orders"), "o_orderkey", same=call("EXACT", x, x), v=F.round(call("VALUE", call("FIXED", x, 6)), 1))


@query("date_fns", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, dayofweek(o_orderdate) + 1 AS wd, weekofyear(o_orderdate) AS w, CAST(CAST(o_orderdate + INTERVAL 3 MONTH AS DATE) AS VARCHAR) AS e, CAST(last_day(CAST(o_orderdate AS DATE)) AS VARCHAR) AS z, date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS s FROM orders")
def date_fns(spark, d):
    from cellflow.functions.datetime import serial

    o = F.col("o_orderdate")
    return named(table(spark, d, "orders"), "o_orderkey", y=call("YEAR", o), m=call("MONTH", o), wd=call("WEEKDAY", o), w=call("ISOWEEKNUM", o), e=call("EDATE", o, 3).cast("string"), z=call("EOMONTH", o, 0).cast("string"), s=serial(o))


@query("datedif", "SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2030-01-01') AS d, (CAST(year(DATE '2030-01-01') AS INT) - year(o_orderdate)) * 12 + 1 - month(o_orderdate) - CASE WHEN 1 < day(o_orderdate) THEN 1 ELSE 0 END AS m FROM orders")
def datedif(spark, d):
    o = F.col("o_orderdate")
    return named(table(spark, d, "orders"), "o_orderkey", d=call("DATEDIF", o, "2030-01-01", "D"), m=call("DATEDIF", o, "2030-01-01", "M"))


@query("networkdays", "SELECT o_orderkey, (SELECT count(*) FROM range(0, 31) t(i) WHERE isodow(CAST(o_orderdate AS DATE) + CAST(i AS INT)) < 6) AS n FROM orders")
def networkdays(spark, d):
    o = F.to_date("o_orderdate")
    return named(table(spark, d, "orders"), "o_orderkey", n=call("NETWORKDAYS", o, F.date_add(o, 30)))


@query("days360_yearfrac", "SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2031-06-15') AS DOUBLE) / 365 AS f3, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2031-06-15') AS DOUBLE) / 360 AS f2 FROM orders")
def days360_yearfrac(spark, d):
    o = F.col("o_orderdate")
    return named(table(spark, d, "orders"), "o_orderkey", f3=call("YEARFRAC", o, "2031-06-15", 3), f2=call("YEARFRAC", o, "2031-06-15", 2))


@query("round_family", "SELECT l_orderkey, floor(l_extendedprice * 10 + 0.5) / 10 AS r, ceil(l_extendedprice * 10) / 10 AS u, floor(l_extendedprice * 10) / 10 AS d, floor(l_extendedprice / 5 + 0.5) * 5 AS m, ceil(l_extendedprice / 7) * 7 AS c, floor(l_extendedprice) AS i FROM lineitem")
def round_family(spark, d):
    x = F.col("l_extendedprice")
    return named(table(spark, d, "lineitem"), "l_orderkey", r=call("ROUND", x, 1), u=call("ROUNDUP", x, 1), d=call("ROUNDDOWN", x, 1), m=call("MROUND", x, 5), c=call("CEILING", x, 7), i=call("INT", x))


@query("trig_fns", "SELECT c_custkey, round(sin(c_acctbal), 8) AS s, round(atan2(c_custkey, c_acctbal), 8) AS a, round(exp(c_acctbal / 1e4), 8) AS e, round(degrees(c_custkey), 6) AS g, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 8) END AS l, CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 8) END AS q FROM customer")
def trig_fns(spark, d):
    x, k = F.col("c_acctbal"), F.col("c_custkey")
    return named(table(spark, d, "customer"), "c_custkey", s=F.round(call("SIN", x), 8), a=F.round(call("ATAN2", x, k), 8), e=F.round(call("EXP", x / 1e4), 8), g=F.round(call("DEGREES", k), 6), l=F.round(call("LN", x), 8), q=F.round(call("SQRT", x), 8))


@query("integer_fns", "SELECT p_partkey, CAST(gcd(p_partkey, p_size) AS BIGINT) AS g, CAST(lcm(p_partkey, p_size) AS BIGINT) AS l, p_partkey - 7 * floor(p_partkey / 7) AS m, p_size * (p_size - 1) / 2 AS c FROM part WHERE p_size > 1")
def integer_fns(spark, d):
    a, b = F.col("p_partkey"), F.col("p_size")
    return named(table(spark, d, "part").where("p_size > 1"), "p_partkey", g=call("GCD", a, b), l=call("LCM", a, b), m=call("MOD", a, 7), c=call("COMBIN", b, 2))


@query("logical_fns", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'hi' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'lo' END AS b, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS s, (o_totalprice > 100000) <> (o_orderstatus = 'F') AS x FROM orders")
def logical_fns(spark, d):
    p, s = F.col("o_totalprice"), F.col("o_orderstatus")
    return named(table(spark, d, "orders"), "o_orderkey", b=call("IFS", p > 200000, "hi", p > 100000, "mid", F.lit(True), "lo"), s=call("SWITCH", s, "f", 1, "o", 2, 3), x=call("XOR", p > 100000, s == "F"))


@query("info_fns", "SELECT p_partkey, p_size % 2 = 0 AS e, p_size % 2 <> 0 AS o, p_name IS NULL AS b, true AS t, false AS n FROM part")
def info_fns(spark, d):
    return named(table(spark, d, "part"), "p_partkey", e=call("ISEVEN", F.col("p_size")), o=call("ISODD", F.col("p_size")), b=call("ISBLANK", F.col("p_name")), t=call("ISTEXT", F.col("p_name")), n=call("ISNUMBER", F.col("p_name")))


@query("bit_radix", "SELECT p_partkey, p_partkey & 7 AS a, p_partkey | 5 AS o, xor(p_partkey, 5) AS x, upper(to_hex(p_partkey)) AS h, p_partkey * 4 AS l FROM part WHERE p_partkey >= 0")
def bit_radix(spark, d):
    k = F.col("p_partkey")
    return named(table(spark, d, "part"), "p_partkey", a=call("BITAND", k, 7), o=call("BITOR", k, 5), x=call("BITXOR", k, 5), h=call("DEC2HEX", k), l=call("BITLSHIFT", k, 2))


@query("complex_fns", "SELECT p_partkey, round(sqrt(p_size * p_size + p_retailprice * p_retailprice), 6) AS a, CAST(p_size AS DOUBLE) AS r, p_retailprice AS i, round(atan2(p_retailprice, p_size), 8) AS g FROM part")
def complex_fns(spark, d):
    z = call("COMPLEX", F.col("p_size"), F.col("p_retailprice"))
    return named(table(spark, d, "part"), "p_partkey", a=r6(call("IMABS", z)), r=call("IMREAL", z), i=call("IMAGINARY", z), g=F.round(call("IMARGUMENT", z), 8))


@query("convert_units", "SELECT p_partkey, round(p_size * 1.609344, 8) AS km, round((p_size - 32) * 5 / 9.0, 8) AS c, round(p_size * 453.59237, 6) AS g FROM part")
def convert_units(spark, d):
    x = F.col("p_size")
    return named(table(spark, d, "part"), "p_partkey", km=F.round(call("CONVERT", x, "mi", "km"), 8), c=F.round(call("CONVERT", x, "F", "C"), 8), g=F.round(call("CONVERT", x, "lbm", "g"), 6))


@query("annuities", "SELECT c_custkey, round(-c_acctbal * power(1.01, 12) * 0.01 / (power(1.01, 12) - 1), 6) AS p, round(-(c_acctbal * power(1.01, 12) + 100 * (power(1.01, 12) - 1) / 0.01), 6) AS f, round(c_acctbal * 0.01, 6) AS i, round((c_acctbal - 50) / 8, 6) AS s FROM customer")
def annuities(spark, d):
    x = F.col("c_acctbal")
    return named(table(spark, d, "customer"), "c_custkey", p=r6(call("PMT", 0.01, 12, x)), f=r6(call("FV", 0.01, 12, 100, x)), i=r6(call("IPMT", 0.01, 1, 12, x)), s=r6(call("SLN", x, 50, 8)))


@query("npv", "SELECT round(sum(value / power(1.0001, rn)), 6) AS v FROM (SELECT value, row_number() OVER (ORDER BY event_id) AS rn FROM events)")
def npv(spark, d):
    t = numbered(table(spark, d, "events").select("event_id", "value"), "event_id")
    return t.agg(r6(A.npv(0.0001, F.col("value"), F.col("_row"))).alias("v"))


@query("xnpv", "SELECT round(sum(o_totalprice / power(1.05, date_diff('day', f, CAST(o_orderdate AS DATE)) / 365.0)), 2) AS v FROM orders, (SELECT CAST(min(o_orderdate) AS DATE) AS f FROM orders)")
def xnpv(spark, d):
    t = table(spark, d, "orders")
    first = t.agg(F.to_date(F.min("o_orderdate")).alias("first"))
    return t.crossJoin(F.broadcast(first)).agg(F.round(A.xnpv(0.05, F.col("o_totalprice"), F.to_date("o_orderdate"), F.col("first")), 2).alias("v"))  # one row


@query("discounted_bills", "SELECT o_orderkey, round(100 * (1 - 0.05 * 90 / 360), 6) AS p, round((100 - o_totalprice / 1e4) / 100 / (90 / 360.0), 6) AS d FROM orders")
def discounted_bills(spark, d):
    o = F.to_date("o_orderdate")
    return named(table(spark, d, "orders"), "o_orderkey", p=r6(call("TBILLPRICE", o, F.date_add(o, 90), 0.05)), d=r6(call("DISC", o, F.date_add(o, 90), F.col("o_totalprice") / 1e4, 100)))


@query("closed_distributions", "SELECT p_partkey, round(1 - exp(-0.1 * p_size), 8) AS e, round(1 - exp(-power(p_size / 20.0, 1.5)), 8) AS w, round(exp(-p_size * p_size / 200.0) / sqrt(2 * pi()) / 10, 8) AS n FROM part")
def closed_distributions(spark, d):
    x = F.col("p_size")
    return named(table(spark, d, "part"), "p_partkey", e=F.round(call("EXPON.DIST", x, 0.1, True), 8), w=F.round(call("WEIBULL.DIST", x, 1.5, 20, True), 8), n=F.round(call("NORM.DIST", x, 0, 10, False), 8))


@query("special_distributions")
def special_distributions(spark, d):
    x = F.col("p_size")
    return named(dealt(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey"), "p_partkey", g=call("GAMMA.DIST", x, 2, 3, True), b=call("BINOM.DIST", x, 60, 0.4, True), t=call("T.DIST", x / 10, 5, True), c=call("CHISQ.DIST.RT", x, 7), i=call("T.INV.2T", 1 / (x + 1), 9))


@query("hypothesis_tests")
def hypothesis_tests(spark, d):
    t = table(spark, d, "lineitem")
    a, b = F.when(t.l_returnflag == "A", t.l_quantity), F.when(t.l_returnflag == "N", t.l_quantity)
    return t.agg(A.t_test(a, b, 2, 3).alias("t"), A.f_test(a, b).alias("f"), A.ztest(t.l_quantity, 25).alias("z"))


@query("internal_rates")
def internal_rates(spark, d):
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(-F.col("value")).alias("flow"))
    return cashflow.dated_rate(e, "user_id", "flow", "day")


@query("matrix_product", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 4) AS v FROM embeddings")
def matrix_product(spark, d):
    x = F.transform("embedding", lambda v: v.cast("double"))
    product = call("MMULT", F.array(x), F.transform(x, lambda v: F.array(v)))
    return named(table(spark, d, "embeddings"), "vec_id", v=F.round(F.get(F.get(product, F.lit(0)), F.lit(0)), 4))


# rows to text and back


@query("csv_kinds", "SELECT p_partkey, 't' AS a, 'n' AS b FROM part")
def csv_kinds(spark, d):
    return named(table(spark, d, "part"), "p_partkey", a=infer_cell(F.col("p_name")), b=infer_cell(F.col("p_size").cast("string")))


@query("markdown_sink", "SELECT '| ' || r_regionkey || ' | ' || replace(r_name, '|', '\\|') || ' |' AS value FROM region")
def markdown_sink(spark, d):
    return markdown_rows(table(spark, d, "region").select("r_regionkey", "r_name"))


@query("html_sink", "SELECT n_nationkey, replace(replace(n_name, '&', '&amp;'), '<', '&lt;') AS v FROM nation")
def html_sink(spark, d):
    return named(table(spark, d, "nation"), "n_nationkey", v=escaped_html(F.col("n_name")))


@query("json_sink", "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS value FROM region")
def json_sink(spark, d):
    return json_rows(table(spark, d, "region").select("r_regionkey", "r_name"))


@query("template_fill", "SELECT c_custkey, 'Dear ' || c_name || ', {sum}: ' || c_mktsegment AS filled FROM customer")
def template_fill(spark, d):
    return filled_template(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), r"Dear {c_name}, \{sum\}: {.c_mktsegment}").select("c_custkey", "filled")
