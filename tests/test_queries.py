"""Every registered query with SQL gives the SQL's rows."""

import glob

import pytest

import __spark_entry__ as entry
from keyloom.plans import registry

DIR = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted({**registry.oracle_sql(), **registry.cases()}))
def test_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        db.execute(f"CREATE VIEW {path.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{path}'")
    query, sql = registry.cases()[name] if name in registry.CASES else (registry.queries()[name], registry.oracle_sql()[name])
    got, want = query(spark, DIR).toPandas(), db.execute(sql).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda df: sorted(map(tuple, df[columns].astype(str).values.tolist()))
    assert plain(got) == plain(want)


def test_the_rest_has_queries_without_the_training_data_part():
    assert registry.FLAGSHIP in registry.queries() and set(registry.oracle_sql()) <= set(registry.queries())
