"""Every registered query of the engine's own operators runs on the smallest tables; those with SQL agree with DuckDB."""

import os

import pytest

from weftline.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLES:
        assert df.columns
        return
    found = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(found.columns)
    cols = sorted(df.columns)
    want = sorted(([plain(r[found.columns.index(c)]) for c in cols] for r in found.fetchall()), key=repr)
    assert sorted(([plain(r[c]) for c in cols] for r in rows), key=repr) == want
