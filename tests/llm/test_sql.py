"""The queries that SQL can express against their SQL in DuckDB, on whole tables."""

import os

import duckdb
import pytest

from vekspar.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    want = duck.sql(oracle_sql()[name])
    got = queries()[name](spark, SF).select(*want.columns)
    first = want.columns[0]  # the row's id, unique in these tables
    assert sorted(map(tuple, got.orderBy(first).collect()), key=lambda r: r[0]) == sorted(want.fetchall(), key=lambda r: r[0])


def test_repeats_sql_by_hand(duck):
    """The bytes that the SQL of op7 removes, where they are plain to see."""
    one = "".join(chr(97 + i % 26) + str(i) for i in range(60))
    texts = [(1, one), (2, one[:50]), (3, "é" + one[5:70] + "xyz" + one[5:54]), (4, None), (5, "xyz" + one[5:54])]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    got = {r[0]: r[1:4] for r in c.sql(oracle_sql()["op7_suffix_dedup"]).fetchall()}
    assert got == {1: (len(one), 0, 0), 2: (50, 50, 1), 3: (2 + 65 + 3 + 49, 65, 1), 4: (0, 0, 0), 5: (52, 52, 1)}
