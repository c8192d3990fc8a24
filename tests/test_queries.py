"""Every query that has SQL, against it, on the smallest tables."""

import duckdb
import pytest
from marlstone.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "documents"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    found = registry.queries()[name](spark, SF)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert found.count() > 0
        return
    want = con.sql(sql)
    assert sorted(found.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in found.columns]
    assert sorted(str(tuple(r)) for r in found.collect()) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())
