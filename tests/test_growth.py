"""Work that must not grow faster than its input."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellflow.functions import distributions as D
from cellflow.functions.core import call
from cellflow.operators import aggregates as A
from cellflow.plans import queries  # noqa: F401  registers the functions
from cellflow.sources import markup


def test_inverses_take_few_steps_of_whole_arrays():
    steps = []

    def cdf(x, df):
        steps.append(len(x))
        return D.t_cdf(x, df)

    p = np.linspace(0.001, 0.999, 2001)
    n = np.full(len(p), 2.0)
    found = D.solve(cdf, p, np.full(len(p), -1e6), np.full(len(p), 1e6), n)
    assert np.allclose(found, (2 * p - 1) * np.sqrt(2 / (1 - (2 * p - 1) ** 2)), rtol=1e-9, atol=1e-9)
    assert sum(steps) < 60 * len(p)


def test_inverses_reach_far_tails(spark):
    """Bounds are no answer: T.INV stopped at -1,000,000."""
    rows = spark.createDataFrame([(1e-9, 1.0), (0.5, 100000.0), (None, 1.0), (0.0, 3.0)], "p double, n double").coalesce(1)
    got = [r.v for r in rows.select(call("T.INV", F.col("p"), F.col("n")).alias("v")).collect()]
    assert got[0] == pytest.approx(-318309886.18, rel=1e-6)
    assert got[1:] == [0.0, None, None]
    again = rows.select(call("T.DIST", call("T.INV", F.col("p"), F.col("n")), F.col("n"), True).alias("v")).first().v
    assert again == pytest.approx(1e-9, rel=1e-6)


def test_a_complex_number_keeps_a_small_plan(spark):
    """Each use of a part held the text's parsing anew."""
    rows = spark.createDataFrame([("1+2i",), ("-i",), (".5",), ("1e2j",), ("x",), ("",), (None,), ("0",)], "z string").coalesce(1)
    made = rows.select(*[call(n, F.col("z")).alias(n) for n in ("IMCONJUGATE", "IMLN", "IMREAL", "IMAGINARY")], call("IMDIV", F.col("z"), "1-i").alias("d"), call("IMPOWER", F.col("z"), 2).alias("p"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == 0
    got = [tuple(r) for r in made.collect()]
    assert [r[0] for r in got] == ["1-2i", "i", "0.5", "-100i", None, None, None, "0"]
    assert [r[2:4] for r in got] == [(1.0, 2.0), (0.0, -1.0), (0.5, 0.0), (0.0, 100.0), (None, None), (None, None), (None, None), (0.0, 0.0)]
    assert [r[4] for r in got] == ["-0.5+1.5i", "0.5-0.5i", "0.25+0.25i", "-50+50i", None, None, None, "0"]
    assert got[7][1] is None and got[1][5].startswith("-1")


def _small_batches(kind: str, text: str) -> None:
    """Cells leave a task as they are found, not when all documents of a batch are read."""
    read = 0

    def given():
        nonlocal read
        for i in range(5):
            read = i
            yield pa.RecordBatch.from_pydict({"doc": list(range(i * 10, i * 10 + 10)), "text": [text] * 10})

    out = markup.cell_batches(given(), kind, at_a_time=7)
    first = next(out)
    assert (first.num_rows, read) == (7, 0)
    rows = [tuple(r.values()) for b in [first, *out] for r in b.to_pylist()]
    assert rows == [(d, 0, "T", r, c, f"{'ab'[c]}{r or ''}") for d in range(50) for r in (0, 1) for c in (0, 1)]


def test_markdown_cells_leave_in_small_batches():
    _small_batches("markdown", "# T\n\n| a | b |\n|---|---|\n| a1 | b1 |\n")


def test_html_cells_leave_in_small_batches():
    _small_batches("html", "<table><caption>T</caption><tr><th>a</th><th>b</th></tr><tr><td>a1</td><td>b1</td></tr></table>")


def test_aggregate_codes_gather_no_column(spark, tmp_path):
    """The median and the percentiles of a whole table held every value in one task."""
    values = [5.0, 1.0, None, 3.0, 8.0, 8.0, 2.0, 13.0, 1.5]
    spark.createDataFrame([(v,) for v in values], "o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    made = queries.QUERIES["aggregate_codes"](spark, str(tmp_path))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert not any(f in plan for f in ("median(", "percentile(", "collect_list("))
    assert tuple(made.first()) == (4.0, 2.1, 8.0)
    df = spark.createDataFrame([(v,) for v in values], "x double")
    both = A.aggregates(df, "x", e=(18, 0.3), i=(16, 0.3), q=(19, 1), m=(12,)).first()
    alone = df.agg(A.aggregate(18, df.x, 0.3), A.aggregate(16, df.x, 0.3), A.aggregate(19, df.x, 1), A.aggregate(12, df.x)).first()
    assert both.asDict().keys() == {"e", "i", "q", "m"} and tuple(both) == pytest.approx(tuple(alone))
    assert tuple(A.aggregates(df.where("x > 99"), "x", e=(18, 0.3), m=(12,)).first()) == (None, None)


def test_json_cells_leave_in_small_batches():
    _small_batches("json", '{"tables": [{"name": "T", "rows": [{"a": "a1", "b": "b1"}]}]}')


def test_documents_reach_a_task_in_batches_of_bounded_bytes(spark, monkeypatch):
    """A batch of 10,000 documents, as rows alone would count, could be gigabytes."""

    def sizes(batches, kind):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([v], of) for v, of in zip((b.num_rows, 0, "", 0, 0, str(b.nbytes)), markup._CELL_TYPES, strict=True)], names=[c.split()[0] for c in markup.CELLS.split(", ")])

    monkeypatch.setattr(markup, "cell_batches", sizes)
    docs = spark.range(150).coalesce(1).select("id", F.repeat(F.lit("x"), 1_000_000).alias("t"))
    got = markup.table_cells(docs, "id", "t", "html").collect()
    assert sum(r.doc_id for r in got) == 150
    assert max(int(r.value) for r in got) < 72_000_000
