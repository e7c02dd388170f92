"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from slipmill import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(rows, order):
    text = lambda v: round(v, 5) if isinstance(v, float) else v
    return sorted((tuple(text(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, tables, name):
    got = catalog.QUERIES[name](spark, str(DATA))
    want = tables.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    assert plain(got.collect(), [got.columns.index(columns[i]) for i in order]) == plain(want.fetchall(), order)
