"""Every query of the catalog against its SQL in another engine."""

from pathlib import Path

import duckdb
import pytest

from wavelark.plans import catalog, catalog_sql

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(repr(round(x, 6)) if isinstance(x, float) else str(x) for x in r) for r in frame.itertuples(index=False, name=None))


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog_sql.oracle_sql())


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, sql, name):
    got = catalog.queries()[name](spark, str(DATA)).toPandas()
    want = sql.execute(catalog_sql.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
