"""Every query with SQL gives the rows that DuckDB gives, on the smallest driver tables."""

import os

import duckdb
import pytest

from tessera.plans.vision import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables aren't here")


def plain(v):
    v = float(v) if type(v).__name__ == "Decimal" else v
    return round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(plain(v) for v in r) for r in df.select(*columns).collect()]
    if name not in ORACLES:
        assert got
        return
    rows = db.sql(ORACLES[name])
    at = [rows.columns.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in at) for r in rows.fetchall()]
    order = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(got, key=order) == sorted(want, key=order)
