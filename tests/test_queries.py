"""Every query of the core that has SQL gives the rows of its SQL, on the smallest tables."""

import os

import pytest

from paperloom.plans import catalogue, derived

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
QUERIES = catalogue.queries() | derived.queries()
SQL = catalogue.oracle_sql() | derived.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_are_those_of_the_sql(spark, tables, name):
    found = QUERIES[name](spark, DATA)
    wanted = tables.execute(SQL[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    assert _rows(found.columns, found.collect()) == _rows(columns, wanted.fetchall())
