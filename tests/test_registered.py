"""Every registered query against its SQL, on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as registered

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")

QUERIES = {q.__name__: q for q in registered._QUERIES}
SQL = {name: sql for name, sql in registered.oracle_sql().items() if name in QUERIES}


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    return "null" if value is None else str(value)


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS FROM '{table}'")
    return con


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name not in SQL:
        assert got
        return
    result = con.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    spots = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in spots) for r in result.fetchall())


def test_entry(spark):
    assert registered.entry(spark).count() == registered.K
