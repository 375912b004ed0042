"""Every registered query against its DuckDB oracle on the smallest data set
(the driver's check runs the same comparison at sf0.01)."""

import duckdb
import pytest

import __spark_entry__ as E
from ragtally import catalog
from ragtally.sources.tables import TABLES
from tools.oracle_check import rows_of

SF = "/root/testdata/sf0.001"
# the queries of the subpackage `llm` have their own tests
QUERIES = {k: E.queries()[k] for k in catalog.QUERIES}
ORACLE = {k: v for k, v in E.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    yield c
    c.close()


def test_every_key_has_oracle_or_is_rows_only():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_oracle(spark, con, key):
    sdf = QUERIES[key](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    rel = con.execute(ORACLE[key])
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert rows_of(sdf.columns, srows) == rows_of(dcols, drows)
    # no plan may pair every row with every row
    assert "CartesianProduct" not in sdf._jdf.queryExecution().executedPlan().toString()


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[:3] == ["Model", "Model_ret", "Difficulty"]
    assert df.count() > 0
