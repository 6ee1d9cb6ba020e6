"""Every query with an oracle gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

from chunkmere.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows_of(names, rows):
    key = lambda x: tuple((v is None, str(v)) for v in x)
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=key)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_against_oracle(spark, duck, name):
    found = catalogue.QUERIES[name](spark, DATA)
    want = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(found.columns) == sorted(names)
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_oracle_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0
