"""Every training-data query that has SQL gives the rows of its SQL, on the smallest tables; the others keep their columns on empty ones."""

import os

import pytest

from paperloom.llm import queries as Q

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
SQL = Q.oracle_sql()


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
    found = Q.queries()[name](spark, DATA)
    wanted = tables.execute(SQL[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    assert _rows(found.columns, found.collect()) == _rows(columns, wanted.fetchall())


EMPTY = ("arxiv_silver_plus", "arxiv_text_parquet", "arxiv_metadata_sample", "chunks_sample", "minhash_signatures", "documents")


@pytest.fixture(scope="module")
def empty_tables(spark, tables, tmp_path_factory):
    """All tables without rows but the fixed word list, with one column more that clashes with names the operators use."""
    folder = tmp_path_factory.mktemp("empty")
    for name in EMPTY:
        rows = spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).selectExpr("*", "1 AS key", "'x' AS class_id")
        rows.write.parquet(str(folder / f"{name}.parquet"))
    spark.read.parquet(f"{DATA}/common_words.parquet").write.parquet(str(folder / "common_words.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_empty_tables_give_no_rows(spark, empty_tables, name):
    assert Q.queries()[name](spark, empty_tables).count() == 0
