"""Every core query with SQL gives what DuckDB gives on the smallest test tables."""

import glob
import math
import os

import duckdb
import pytest

from claimframe import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5f}"
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)[:26].replace("+00:00", "") if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall())
    assert got == want
