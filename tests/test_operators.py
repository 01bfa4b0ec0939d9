"""Operators over small tables: ties, nulls, case, empty tables."""

import pytest
from pyspark.sql import functions as F

from cellflow.operators import aggregates as A
from cellflow.operators import cashflow, database, dynamic, lookup
from cellflow.operators.criteria import criterion
from cellflow.operators.ordinal import numbered
from cellflow.sources import csv, markup, xlsx
from cellflow.streaming import each_page, read_landing

PEOPLE = [("Alice", 25, 50000.0), ("Bob", 35, 60000.0), ("Carol", 45, 70000.0), ("Dave", 35, 55000.0)]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, "Name string, Age int, Salary double")


def values(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(("wanted", "met"), [(">=25", ["30", "25"]), ("a*", ["Apple", "a"]), ("?", ["a"]), ("<>a", ["30", "25", "Apple", "", None]), ("=", ["", None]), ("<>", ["30", "25", "Apple", "a"]), ("~*", []), ("25", ["25"])])
def test_criteria(spark, wanted, met):
    df = spark.createDataFrame([(v,) for v in ["30", "25", "Apple", "a", "", None]], "x string")
    assert [r.x for r in df.where(criterion(df.x, wanted)).collect()] == met


def test_database(people):
    assert values(database.aggregate("DSUM", people, "salary", [{"AGE": ">30"}])) == [(185000.0,)]
    assert values(database.aggregate("DGET", people, "Salary", [{"Age": "35"}])) == [(None,)]
    assert values(database.aggregate("DGET", people, "Name", [{"Age": "45"}])) == [("Carol",)]
    assert values(database.aggregate("DCOUNT", people, "Salary", [{"Age": "99"}])) == [(0,)]


def test_empty_aggregates(spark):
    empty = spark.createDataFrame([], "x double")
    row = empty.agg(A.sum_(F.col("x")), A.max_(F.col("x")), A.product(F.col("x")), F.avg("x"), F.median("x")).first()
    assert list(row) == [0.0, 0.0, 0.0, None, None]


def test_lookup_takes_the_first_match_once(spark, people):
    table = spark.createDataFrame([(1, "bob", "x"), (2, "BOB", "y"), (3, None, "z")], "i int, k string, v string")
    got = {r.Name: r.v for r in lookup.xlookup(people, "Name", table, "k", "v", "i", if_not_found="-").collect()}
    assert got == {"Alice": "-", "Bob": "x", "Carol": "-", "Dave": "-"}
    last = {r.Name: r.v for r in lookup.xlookup(people, "Name", table, "k", "v", "i", last=True).collect()}
    assert last["Bob"] == "y"


@pytest.mark.parametrize("larger", [False, True])
def test_nearest_against_brute_force(spark, larger):
    left = [(i, float((i * 37) % 101) if i % 9 else None) for i in range(200)]
    right = [(i, float((i * 53) % 97), i) for i in range(60)]
    a, b = spark.createDataFrame(left, "i int, x double"), spark.createDataFrame(right, "o int, k double, v int")
    got = {r.i: r.k2 for r in lookup.nearest(a, "x", b, "k", "k", "o", larger=larger, name="k2").collect()}
    for i, x in left:
        near = [k for _, k, _ in right if x is not None and (k >= x if larger else k <= x)]
        assert got[i] == ((min if larger else max)(near) if near else None)


def test_numbering_and_limits(spark):
    df = spark.createDataFrame([(i * 7 % 50,) for i in range(50)], "x int")
    assert sorted(values(numbered(df, "x"))) == [(i, i + 1) for i in range(50)]
    assert sorted(values(dynamic.take(df, -3, "x"))) == [(47,), (48,), (49,)]
    assert sorted(values(dynamic.drop(df, -48, "x"))) == [(0,), (1,)]
    assert values(dynamic.choose_rows(df, [2, -1, 2], "x")) == [(1,), (49,), (1,)]
    with pytest.raises(ValueError, match="VALUE"):
        dynamic.choose_rows(df, [51], "x")


def test_unique_ignores_case(spark):
    df = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "i int, t string")
    assert sorted(values(dynamic.unique(df, "t", row="i"))) == [(1, "a"), (3, "b")]
    assert values(dynamic.unique(df, "t", row="i", exactly_once=True)) == [(3, "b")]


def test_ranks_with_ties(spark):
    df = spark.createDataFrame([(5,), (7,), (7,), (None,), (1,)], "x int")
    assert sorted(values(dynamic.rank(df, "x")), key=str) == sorted([(5, 3), (7, 1), (7, 1), (None, None), (1, 4)], key=str)
    assert {r.x: r["rank"] for r in dynamic.rank(df, "x", average=True).collect()}[7] == 1.5


def test_rates(spark):
    flows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([-70000, 12000, 15000, 18000, 21000, 26000])] + [("b", 0, 5.0)], "k string, t int, v double")
    got = {r.k: r.irr for r in cashflow.internal_rate(flows, "k", "v", "t").collect()}
    assert abs(got["a"] - 0.0866309) < 1e-6
    assert got["b"] is None


def test_t_test(spark):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip([3, 4, 5, 8, 9, 1, 2, 4, 5], [6, 19, 3, 2, 14, 4, 5, 17, 1], strict=True)], "a double, b double")
    assert abs(df.agg(A.t_test(df.a, df.b, 2, 1)).first()[0] - 0.196016) < 1e-6


def test_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes("﻿姓名;年纪;c\na;007;true\n\nb;12;FALSE\n".encode())
    df = csv.read_csv(spark, str(path), infer=True)
    assert df.dtypes == [("姓名", "string"), ("年纪", "string"), ("c", "boolean")]
    assert df.count() == 2
    path.write_bytes("a,b\nü,1\n".encode("cp1252"))
    assert values(csv.read_csv(spark, str(path), infer=True)) == [("ü", 1.0)]
    path.write_bytes("姓名,b\n张三,1\n".encode("gbk"))
    assert values(csv.read_csv(spark, str(path), encoding="GBK")) == [("张三", "1")]
    assert csv.detect_delimiter('"a;b",c\n') == ","


def test_tables_in_documents(spark):
    text = "# Orders\n\n| id | name |\n|---|:-:|\n| 007 | a\\|b |\n| 8 |\n\n## Totals\nid | v\n--|--\n1 | 2\n"
    html = "<table id='t'><caption>Cap</caption><tr><th rowspan=2>a</th><th colspan='2'>b</th></tr><tr><td>c<td>d</tr></table>"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "no table")], "i int, t string")
    got = {tuple(r) for r in markup.table_cells(docs, "i", "t", "markdown").collect()}
    assert (1, 0, "Orders", 1, 0, "007") in got
    assert (1, 0, "Orders", 1, 1, "a|b") in got
    assert (1, 1, "Totals", 1, 1, "2") in got
    cells = {tuple(r)[2:] for r in markup.table_cells(spark.createDataFrame([(1, html)], "i int, t string"), "i", "t", "html").collect()}
    assert cells == {("Cap", 0, 0, "a"), ("Cap", 0, 1, "b"), ("Cap", 1, 1, "c"), ("Cap", 1, 2, "d")}


def test_workbook_round_trip(spark, people, tmp_path):
    books = xlsx.workbooks(people.coalesce(1)).collect()
    (tmp_path / "p.xlsx").write_bytes(bytes(books[0].content))
    cells = xlsx.read_cells(spark, str(tmp_path / "p.xlsx"))
    rows = xlsx.as_table(cells, ["Name", "Age", "Salary"]).orderBy("_row").collect()
    assert [(r.Name, int(r.Age), float(r.Salary)) for r in rows] == PEOPLE


def test_template(people):
    got = markup.filled_template(people, r"\{x\} {name}-{.age}{none}").orderBy("Name").first().filled
    assert got == "{x} Alice-25"


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / f"in/{i}.csv").write_text(f"id,name\n{i},a\n")
    pages = []
    rows = read_landing(spark, str(tmp_path / "in"), "id int, name string", files_each=1)
    each_page(rows, lambda page, n: pages.append(page.count()), str(tmp_path / "state")).awaitTermination(120)
    assert sum(pages) == 3
    assert len(pages) == 3


def test_rows(spark):
    from cellflow.sources.rows import Field, failures, map_rows

    df = spark.createDataFrame([("7", " 2024-02-29 ", "1,234.5", "yes", "a"), ("x", "45292", "", "no", "b"), ("", " ", None, "", None)], "id string, ` Date ` string, amount string, ok string, e string")
    fields = [Field("ok", "boolean"), Field("number", "int", headers=("id",)), Field("date", "date", headers=("Date",), order=1), Field("amount", "double", default=-1.0), Field("last", index=4), Field("none", "int")]
    got = map_rows(df, fields)
    assert got.columns == ["last", "date", "ok", "number", "amount", "none"]
    assert [tuple(map(str, r)) for r in got.collect()] == [("a", "2024-02-29", "True", "7", "1234.5", "None"), ("b", "2024-01-01", "False", "None", "-1.0", "None")]
    assert [tuple(r) for r in failures(df, fields).collect()] == [("number", "x")]
    assert map_rows(df, fields, include=["date"]).columns == ["date"]


def test_formats_and_dates():
    assert [csv.detect_format(h) for h in (b"PK\x03\x04x", b"\xd0\xcf\x11\xe0", b" <table><tr>", b'[{"a": 1}]', b"| a | b |\n|---|---|\n", b"a,b\n1,2\n")] == ["xlsx", "xls", "html", "json", "markdown", "csv"]
    assert [xlsx.is_date_format(f) for f in ("yyyy-mm-dd", "[h]:mm", '0.00"days"', "General", "#,##0", "[Red]0.0", "d/m/yy")] == [True, True, False, False, False, False, True]
    assert [xlsx.serial_text(v, e) for v, e in (("45292", False), ("1", False), ("61", False), ("45292.5", False), ("0", True), ("x", False), ("-1", False))] == ["2024-01-01", "1900-01-01", "1900-03-01", "2024-01-01 12:00:00", "1904-01-01", "x", "-1"]


def test_json_tables():
    assert markup.json_tables('[{"a": 1, "b": "x"}, {"b": null, "c": [1]}]') == [("", [["a", "b", "c"], ["1", "x", None], [None, None, "[1]"]])]
    assert markup.json_tables('{"tables": [{"name": "t", "columns": ["p"], "rows": [["007"]]}, {"rows": []}]}') == [("t", [["p"], ["007"]]), ("", [])]
    assert markup.json_tables("no json") == []


def test_spans_are_bounded():
    (name, rows), = markup.html_tables('<table><tr><td rowspan="999999999" colspan="999999999">a</td></tr><tr><td>b</td></tr></table>')
    assert rows == [{0: "a"}, {1000: "b"}]


def test_csv_line_ends_inside_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text('s,n\n"x\ny",1\nz,2\n')
    assert [tuple(r) for r in csv.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("x\ny", "1"), ("z", "2")]
    assert csv.first_bytes(spark, str(tmp_path), 3) == b"s,n"
    assert csv.first_bytes(spark, str(tmp_path / "none*")) == b""


def test_cells_to_types_and_back(spark):
    from cellflow.sources.rows import Field, chosen, converted, failures, stored, with_missing, within_limits

    rows = spark.createDataFrame([("TRUE", "35065.25"), (" 7 ", "1996-01-01"), ("x", None)], "a string, b string")
    got = rows.select(converted(F.col("a"), "int").alias("n"), converted(F.col("a"), "boolean").alias("t"), F.date_format(converted(F.col("b"), "timestamp"), "yyyy-MM-dd HH").alias("d")).collect()
    assert [tuple(r) for r in got] == [(1, True, "1996-01-01 06"), (7, False, "1996-01-01 00"), (None, None, None)]
    numbers = spark.createDataFrame([(1, True), (2, False), (None, None)], "n int, t boolean")
    back = numbers.select(stored(F.col("n"), "int", "boolean").alias("b"), stored(F.col("t"), "boolean", "number").alias("x"), stored(F.col("t"), "boolean", "text").alias("s")).collect()
    assert [tuple(r) for r in back] == [(True, 1.0, "TRUE"), (False, 0.0, "FALSE"), (None, None, None)]
    fields = [Field("p", order=2), Field("q", order=1), Field("r", index=0)]
    assert [f.name for f in chosen(fields)] == ["r", "q", "p"]
    assert [f.name for f in chosen(fields, include_at=[2, 0], as_included=True)] == ["p", "r"]
    assert {tuple(r) for r in failures(rows, [Field("b", "int", headers=("a",))]).collect()} == {("b", "x")}
    assert with_missing(numbers.where("n = 2"), "n", 1, 3).where("t IS NULL").count() == 2
    with pytest.raises(ValueError):
        within_limits(numbers, columns=1)
    with pytest.raises(Exception, match="more than 3 characters"):
        within_limits(rows, characters=3).collect()
