"""Every query with SQL equals DuckDB's answer on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lodestone import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(rows):
    return sorted((tuple(str(v) for v in r) for r in rows))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in catalog.oracle_sql():
        assert rows
        return
    cur = duck.execute(catalog.oracle_sql()[name])
    names, want = [c[0] for c in cur.description], cur.fetchall()
    assert sorted(names) == sorted(df.columns)
    at = [df.columns.index(n) for n in names]
    assert plain([tuple(r[i] for i in at) for r in rows]) == plain(want)
