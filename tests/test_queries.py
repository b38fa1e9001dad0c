"""Each query of the library against its SQL in DuckDB."""

import os

import duckdb
import numpy as np
import pytest

from vekspar.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = queries()[name](spark, SF).toPandas(), duck.sql(oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    for c in cols:
        if got[c].dtype.kind == "f":
            assert np.array_equal(got[c].values, want[c].values.astype(float), equal_nan=True), c
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c


def test_recall_gate(spark):
    got = {r.k: r.recall for r in queries()["ivf_recall"](spark, SF).collect()}
    assert got[1] >= 0.5 and got[10] >= 0.8 and got[100] >= 0.9


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
