"""The driver's contract, and the queries' SQL on the small tables where they and DuckDB are present."""

import os

import pytest

import __spark_entry__ as entry
from cellflow.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


def test_names():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_flagship(spark):
    assert entry.entry(spark).count() == 3


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", ["sumifs", "trimmean", "rank_eq_avg", "lookup_asof", "scan_running", "database_functions", "hstack", "text_fns"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got = QUERIES[name](spark, DATA).toPandas()
    want = con.execute(SQL[name]).df()[list(got.columns)]

    def key(frame):
        return sorted(tuple("" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v).removesuffix(" 00:00:00") for v in r) for r in frame.itertuples(index=False))

    assert key(got) == key(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith(("fn_", "file_", "rows_", "stream_", "import_", "export_"))))
def test_families_and_files_against_sql(spark, name):
    test_against_sql(spark, name)
